"""Storage helpers: the configured folder is used as it is."""

import pytest

from clickfeat import session as S


class _Conf:
    def __init__(self, d):
        self.d = d

    def get(self, key, default=None):
        return self.d.get(key, default)


class _Context:
    def __init__(self, master, folder=None):
        self.master, self.folder = master, folder

    def getCheckpointDir(self):  # noqa: N802
        return self.folder

    def setCheckpointDir(self, d):  # noqa: N802
        self.folder = d


class _Session:
    def __init__(self, master, **conf):
        self.conf, self.sparkContext = _Conf(conf), _Context(master)


def test_configured_folder_is_unchanged():
    s = _Session("yarn", **{"spark.checkpoint.dir": "/shared/ckpt"})
    assert S.ensure_checkpoint_dir(s) == "/shared/ckpt" and s.sparkContext.folder == "/shared/ckpt"
    assert S.scratch_path(s, "x").startswith("/shared/ckpt/clickfeat-stage/x-")


def test_no_folder_off_local_mode_is_an_error():
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            S.ensure_checkpoint_dir(_Session(master))
    assert S.ensure_checkpoint_dir(_Session("local[2]"))


def test_staged_tables_can_be_removed(spark):
    path = S.scratch_path(spark, "gone")
    spark.range(3).write.parquet(path)
    S.drop_scratch(spark, path)
    with pytest.raises(Exception):
        spark.read.parquet(path).count()
    with pytest.raises(ValueError):
        S.drop_scratch(spark, "/tmp/other")


def test_wide_plans_are_written_in_methods_that_are_compiled(spark, monkeypatch):
    import pytest

    from clickfeat.operators import encode as EN
    from clickfeat.session import METHOD_BYTES, compiled
    name = "spark.sql.codegen.hugeMethodLimit"
    old, seen = spark.conf.get(name), []
    df = spark.range(3)
    own = type(df.write).parquet
    monkeypatch.setattr(type(df.write), "parquet", lambda w, path: seen.append(spark.conf.get(name)) or own(w, path))
    assert EN.staged(df, "wide-test", wide=True).count() == EN.staged(df, "wide-test").count() == 3
    assert seen == [METHOD_BYTES, old] and spark.conf.get(name) == old
    with pytest.raises(ZeroDivisionError), compiled(spark):
        1 / 0
    assert spark.conf.get(name) == old
