"""Intermediate tables of a scope are gone at its end; others stay."""

from __future__ import annotations

import os

import pytest

from sluiceway.session import written, written_removed


def test_written_is_removed(spark):
    outside = written(spark.range(3), "test-outside")
    folders = []
    with pytest.raises(RuntimeError):
        with written_removed(spark):
            inside = written(spark.range(5), "test-inside")
            assert inside.count() == 5
            folders += [os.path.dirname(f.removeprefix("file://")) for f in inside.inputFiles()]
            raise RuntimeError
    assert folders and not any(os.path.exists(f) for f in folders)
    assert outside.count() == 3
