"""Rows from named values."""

from tallyloom import schema as S
from tallyloom.sources.sample import FORMS_CSV, LEDGER_CSV, load_sample

__all__ = ["FORMS_CSV", "LEDGER_CSV", "form_row", "ledger_row", "load_sample"]


def ledger_row(**k):
    """A ledger row of empty texts but for the given ones."""
    return tuple(k.get(c, "") for c in S.LEDGER)


def form_row(seq=0, **k):
    """A text form row of empty texts but for the given ones, with its place."""
    return (*[k.get(c, "") for c in S.FORM_TEXT], seq)
