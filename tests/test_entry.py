"""What the entry module offers, and what it does where modules are missing."""

from __future__ import annotations

import pytest

import __spark_entry__


def test_every_sql_has_its_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_absence_is_told_from_faults(tmp_path, monkeypatch):
    monkeypatch.syspath_prepend(str(tmp_path))
    package = tmp_path / "some_package"
    (package / "left").mkdir(parents=True)
    (package / "__init__.py").write_text("")
    (package / "left" / "whole.py").write_text("X = 1")
    (package / "left" / "faulty.py").write_text("import no_such_module_at_all")
    assert __spark_entry__._module("some_package.left.whole").X == 1
    assert __spark_entry__._module("some_package.left.gone") is None and __spark_entry__._module("some_package.gone.queries") is None
    with pytest.raises(ModuleNotFoundError, match="no_such_module_at_all"):
        __spark_entry__._module("some_package.left.faulty")
    (package / "sub").mkdir()
    (package / "sub" / "__init__.py").write_text("import no_such_module_at_all")
    with pytest.raises(ModuleNotFoundError, match="no_such_module_at_all"):
        __spark_entry__._module("some_package.sub.queries")
