"""Folders without empty files are not gone through one by one."""

from __future__ import annotations

import pytest

from folioscan.sources import files


def test_only_folders_with_empty_files_are_gone_through(spark, tmp_path, monkeypatch):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.docx").write_bytes(b"x")
    (tmp_path / "sub" / "b.xlsx").write_bytes(b"y")

    def walked(*_):
        raise AssertionError("gone through")

    with monkeypatch.context() as m:
        m.setattr(files, "_empty_files", walked)
        assert {r.file_name for r in files.list_files(spark, str(tmp_path)).select("file_name").collect()} == {"a.docx", "b.xlsx"}
        (tmp_path / "sub" / "c.docx").write_bytes(b"")
        with pytest.raises(AssertionError):
            files.list_files(spark, str(tmp_path))
    assert {r.file_name: r.file_size for r in files.list_files(spark, str(tmp_path)).select("file_name", "file_size").collect()} == {"a.docx": 1, "b.xlsx": 1, "c.docx": 0}
