import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from cinetide.llm.bytestext import ALNUM, LOWER, WORD, Words, chunks, hash_word, member

texts = st.lists(st.one_of(st.none(), st.text(alphabet="aB z\n\té你.9", max_size=40)), max_size=6)


@settings(max_examples=150, deadline=None)
@given(texts, st.integers(1, 64))
def test_words_are_those_of_the_patterns(values, limit):
    batch = pa.RecordBatch.from_pydict({"text": pa.array(values, pa.string())})
    for table, pattern, lower in ((WORD, r"[^\x20\x09-\x0D]+", False), (ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", True)):
        got = []
        for _, buf, offs in chunks(batch, limit=limit):
            words = Words(LOWER[buf] if lower else buf, offs, table)
            got += [[words.text(i).decode() for i in range(a, b)] for a, b in zip(words.first[:-1], words.first[1:], strict=True)]
            for i, h in enumerate(words.hashes().tolist()):
                assert h == hash_word(words.text(i).decode())
        plain = [(v or "") for v in values]
        if lower:
            plain = [v.translate({c: c + 32 for c in range(65, 91)}) for v in plain]
        assert got == [re.findall(pattern, v) for v in plain]


def test_windows_stay_in_their_text():
    raw = [b"a b c d", b"a b", b"", b"b c d a b c d"]
    buf = np.frombuffer(b"".join(raw), np.uint8)
    words = Words(buf, np.r_[0, np.cumsum([len(r) for r in raw])])
    for lane in (0, 1):
        hashes, at = words.windows(3, lane)
        found = {tuple(words.text(i + k).decode() for k in range(3)): int(h) for i, h in zip(at, hashes, strict=True)}
        assert set(found) == {("a", "b", "c"), ("b", "c", "d"), ("c", "d", "a"), ("d", "a", "b")}
        assert len(set(found.values())) == 4 and len(hashes) == 7


def test_member():
    rng = np.random.default_rng(0)
    table = np.unique(rng.integers(0, 2**63, 1000, dtype=np.uint64))
    probe = np.r_[table[::3], rng.integers(0, 2**63, 1000, dtype=np.uint64)]
    assert (member(probe, table) == np.isin(probe, table)).all()
    assert not member(probe, table[:0]).any()
