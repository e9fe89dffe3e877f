"""What tasks of the divergence audit hand on."""

from collections import Counter
from types import SimpleNamespace

import pyarrow as pa
import pytest

from pathloom.llm import audit


@pytest.mark.parametrize(("matches", "sent"), [(1 << 22, 1 << 17), (1 << 22, 2), (3, 1 << 17)])
def test_a_task_counts_a_term_of_a_source_once(monkeypatch, matches, sent):
    monkeypatch.setattr(audit, "HELD", 2)
    monkeypatch.setattr(audit, "HELD_MATCHES", matches, raising=False)
    monkeypatch.setattr(audit, "SENT", sent, raising=False)
    said = [("en", "a", "one two, three ONE"), ("en", "b", "two"), ("de", "a", "eins one zwei"), ("en", "a", "one four"), ("de", "a", ""), ("en", "a", "two three")]
    batches = [pa.RecordBatch.from_pydict({"lang": [x[0]], "source": [x[1]], "raw": [x[2].encode()]}) for x in said]
    sent_terms = SimpleNamespace(value=(f"unit {matches} {sent}", {"en": [("one", 0), ("two", 1), ("three", 2)], "de": [("one", 3), ("zwei", 4)]}))
    rows = [tuple(r.values()) for b in audit._recount(sent_terms)(iter(batches)) for r in b.to_pylist()]
    total = Counter()
    for source, i, k in rows:
        total[source, i] += k
    assert total == {("a", 0): 3, ("a", 1): 2, ("a", 2): 2, ("b", 1): 1, ("a", 3): 1, ("a", 4): 1}
    # However many entries there are, a task that holds all matches sends each once.
    assert len(rows) == len(total) or matches == 3
