"""Readers/writers (S1-S6, K1-K4) and the stand-in click logs."""
