"""Entries of lists travel in packs, and only wanted lines are hashed again."""

import numpy as np
import pyarrow as pa

from axonframe.llm import linedup


def _binary(rows):
    return pa.array([np.array(r, np.int64).tobytes() for r in rows], pa.binary())


def test_packs_hold_every_entry_once_and_lists_whole():
    tokens = [[4, 9, -3], [9, 12], [], [-3, 4]]
    wide = [[100, 1], [], [100, 0, 101, 1], [100, 1]]
    columns = {"cid": pa.array([7, 8, 9, 10]), "n": pa.array([5, 5, 6, 5], pa.int32()), "s1": pa.array([1, 1, 1, 1]), "s2": pa.array([0, 0, 0, 0]), "skip": pa.array([1, 0, 2, 0], pa.int32()), "tokens": _binary(tokens), "wide": _binary(wide)}
    whole = pa.RecordBatch.from_arrays(list(columns.values()), list(columns))
    found, home, rows = [], {}, 0
    for turn in range(linedup.SLICES + 1):
        for batch in linedup._packer(turn, 3)(iter([whole.slice(0, 1), whole.slice(1)])):
            rows += batch.num_rows
            for task, pack in zip(batch.column(0).to_pylist(), batch.column(1)):
                assert 0 <= task < 3
                x = linedup._unpacked([pa.RecordBatch.from_arrays([pa.array([pack.as_py()], pa.binary())], ["pack"])])
                for v, part, cid, both in zip(x["v"].tolist(), x["part"].tolist(), x["cid"].tolist(), x["np"].tolist()):
                    assert home.setdefault((v, part), task) == task
                    found.append((v, part, cid, both >> 32, both & 0xFFFFFFFF))
    own = zip([7, 8, 9, 10], [5, 5, 6, 5], [1, 0, 2, 0], tokens, wide)
    expected = []
    for cid, n, skip, t, w in own:
        expected += [(v, 0, cid, n, skip + k) for k, v in enumerate(t)]
        expected += [(w[2 * k], w[2 * k + 1] + 1, cid, n, skip + len(t) + k) for k in range(len(w) // 2)]
    assert sorted(found) == sorted(expected)
    assert rows < len(expected)


def test_only_wanted_lines_give_words():
    text = b"a b c\nd e\n\nf"
    data, offs = np.frombuffer(text, np.uint8), np.array([0, len(text)], np.int64)
    words, line, *_ = linedup._line_words(data, offs)
    kept, own, row, number, begin, end = linedup._line_words(data, offs, lambda row, number: number == 1)
    assert line.tolist() == [0, 0, 0, 1, 1, 3]
    assert own.tolist() == [1, 1] and kept.tolist() == words[3:5].tolist()
    assert number.tolist() == [0, 1, 2, 3]
