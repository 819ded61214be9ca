"""The driver's entry without the text operators."""

import pytest


@pytest.mark.parametrize("gone", ["strandlake.llm", "corpus_pipeline"])
def test_entry_without_text_operators(gone, monkeypatch):
    """A folder left empty, or one that can't be imported, costs the queries it has and no others."""
    import sys

    import __spark_entry__

    every = set(__spark_entry__.queries())
    for name in [m for m in sys.modules if m == gone or m.startswith(gone + ".")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, gone + ".queries" if gone.endswith("llm") else gone, None)
    left = set(__spark_entry__.queries())
    lost = every - left
    assert "enriched_words" in left and lost and all(k.startswith("op") or k == "pipeline" for k in lost)
