"""Registered queries use the operators' own number of bootstrap draws."""

from __future__ import annotations

import inspect

import pytest

from planewise.plans import queries as Q


@pytest.mark.parametrize("name", ["compare_techniques", "technique_summary"])
def test_registered_draws(monkeypatch, name):
    whole = inspect.signature(getattr(Q.I, name))
    seen = {}

    def record(*args, **options):
        bound = whole.bind(*args, **options)
        bound.apply_defaults()
        seen.update(bound.arguments)
        raise LookupError

    monkeypatch.setattr(Q.I, name, record)
    monkeypatch.setattr(Q, "_scores", lambda s, d: None)
    with pytest.raises(LookupError):
        Q.PLANS[name](None, "")
    assert seen["n_boot"] == 10000
