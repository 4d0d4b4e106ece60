"""Cases that small prose does not reach: long lists, crowds, damaged archives, targets out of reach, awkward rows and names."""

import hashlib
import itertools

import numpy as np
import pytest

import corpus_pipeline
from axonframe.llm import decontam, linedup, minhash, mixing, pii, substring, warc

COLUMNS = "doc_id long, text string, lang string, source string, __id long, __gone string, spans string, removed string, row string, gone string"


def _clashing(spark, rows):
    """Documents whose other columns have names that the operators might use."""
    return spark.createDataFrame([(i, t, "en", "s", 1, "a", "b", "c", "d", "e") for i, t in rows], COLUMNS)


def _words(seed, n):
    rng = np.random.default_rng(seed)
    return ["".join(rng.choice(list("abcdefghij"), rng.integers(3, 8))) for _ in range(n)]


def _shingles(text):
    w = text.split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def _components(texts):
    """Smallest id of each text's component, by comparing all pairs."""
    sets = {i: _shingles(t) for i, t in texts.items()}
    at = {i: i for i in texts}

    def root(i):
        while at[i] != i:
            i = at[i]
        return i

    for a, b in itertools.combinations(sorted(texts), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= 75 * len(x | y):
            p, q = sorted((root(a), root(b)))
            at[q] = p
    return {i: root(i) for i in texts}


def test_minhash_links_at_the_threshold(spark):
    texts, n = {}, itertools.count()
    for seed, size in enumerate((20, 27, 40, 60, 85, 108, 120, 200, 400)):
        base = _words(seed, size + 4)
        for share in (0.75, 0.8, 0.85):
            texts[next(n)] = " ".join(base)
            texts[next(n)] = " ".join(base[: int(np.ceil(size * share)) + 4])  # a set within the other
            texts[next(n)] = " ".join(base[:-1] + ["changed"])
            texts[next(n)] = " ".join(base + _words(1000 + next(n), int(size * (1 - share))))
    docs = _clashing(spark, list(texts.items()))
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark, docs).collect()}
    assert got == _components(texts)


def test_minhash_crowd_with_strays(spark):
    base, rng = _words(5, 64), np.random.default_rng(6)
    texts = {}
    for i in range(330):  # copies changed at a few places, some of them linked to others only
        own = list(base)
        for _ in range(int(rng.integers(0, 4))):
            own[int(rng.integers(len(own)))] = f"c{i % 7}"
        texts[i] = " ".join(own)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark, _clashing(spark, list(texts.items()))).collect()}
    want = _components(texts)
    assert got == want and len(set(want.values())) > 1


def test_one_of_each_goes_by_text(spark):
    a, b = " ".join(_words(1, 30)), " ".join(_words(2, 30))
    rows = [(1, a), (1, a), (2, a), (2, b), (3, None), (4, ""), (None, a)]
    kept = minhash.one_of_each(spark, _clashing(spark, rows))
    assert kept.columns == _clashing(spark, []).columns
    assert sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == sorted([(1, a), (2, b), (3, ""), (4, ""), (0, a)])
    assert minhash.one_of_each(spark, _clashing(spark, [])).count() == 0


def test_line_dedup_long_lists(spark):
    rng, vocab = np.random.default_rng(4), [f"t{k}" for k in range(14)]
    sets = {frozenset(rng.choice(vocab, 9, replace=False)) for _ in range(1500)}
    lines = [" ".join(sorted(s)) for s in sorted(sets, key=sorted)][:900]
    rng.shuffle(lines)
    docs = [(i, "\n".join(lines[i * 30 : i * 30 + 30])) for i in range(30)]
    every = [(i, k, frozenset(x.split())) for i, t in docs for k, x in enumerate(t.split("\n"))]
    want = {(i, k) for p, (i, k, s) in enumerate(every) if any(100 * len(s & o) >= 75 * len(s | o) for _, _, o in every[:p])}
    got = {(r.doc_id, r.line_no) for r in linedup.repeated_lines(spark, _clashing(spark, docs)).collect()}
    assert got == want


def test_line_dedup_awkward_rows(spark):
    line = " ".join(_words(3, 12))
    rows = [(2, line), (1, "x y\n" + line), (None, line), (3, None), (4, ""), (5, " \n "), (6, line), (6, line)]
    docs = _clashing(spark, rows)
    got = sorted((r.doc_id, r.line_no, r.exact) for r in linedup.repeated_lines(spark, docs).collect())
    assert got == [(2, 0, True), (6, 0, True)]
    kept = linedup.drop_repeated_lines(spark, docs)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id or 0), r.text or "") for r in kept.collect()) == [(0, line), (1, "x y\n" + line), (3, ""), (4, ""), (5, " \n ")]
    assert linedup.drop_repeated_lines(spark, _clashing(spark, [])).count() == 0


def test_substring_lines_paragraphs_and_names(spark):
    words = _words(8, 60)
    line, part = " ".join(words[:20]), "\n".join(" ".join(words[20 + k : 26 + k]) for k in (0, 6, 12, 18))
    docs = _clashing(spark, [(1, "one\n" + line + "\n\n" + part), (2, part + "\n\nother words here"), (3, "é " + "x\n" + line), (None, line), (4, None), (5, "")])
    got = {(r.doc_id, r.start, r.kept_doc_id) for r in substring.repeated_passages(spark, docs).collect()}
    assert got == {(2, 0, 1), (3, 4, 1)}
    cut = substring.drop_repeated_passages(spark, docs, "cut_spans")
    assert cut.columns == [*docs.columns, "cut_spans"]
    texts = {r.doc_id: r.text for r in cut.collect()}
    assert texts[2] == "\n\nother words here" and texts[3] == "é x\n" and texts[None] == line and texts[4] is None
    assert substring.drop_repeated_passages(spark, _clashing(spark, [])).count() == 0


def _record(k, body=None, *more):
    block = b"HTTP/1.1 200 OK\r\n\r\n" + (b"body%d" % k if body is None else body)
    return warc.pack(warc.VERSION, [("WARC-Type", "response"), ("WARC-Record-ID", f"<urn:page:{k}>"), ("Content-Type", "application/http;msgtype=response"), *more], block)


def _ids(data):
    found = list(warc.located(data))
    return [h["warc-record-id"][-2] for kind, _, _, h, _, _ in found if kind == "record"], [x for x in found if x[0] == "gap"]


def test_warc_goes_on_within_a_member():
    records = [_record(k) for k in range(5)]
    records[1] = records[1].replace(b"Content-Length: ", b"Content-Length; ")
    ids, gaps = _ids(warc.zipped(b"".join(records)))
    assert ids == ["0", "2", "3", "4"]
    begin = len(records[0])
    assert [(g[3], g[5]) for g in gaps] == [("damaged record in a member", (begin, begin + len(records[1])))]


def test_warc_keeps_what_a_cut_member_gave():
    records = [_record(k, np.random.default_rng(k).bytes(4000)) for k in range(5)]
    data = warc.zipped(b"".join(records))
    ids, gaps = _ids(data[: -len(data) // 4] + warc.zipped(_record(7)))
    assert ids == ["0", "1", "2", "7"] and len(gaps) == 1 and gaps[0][3] == "damaged member"


def test_warc_holds_digests_against_payloads():
    good = "sha1:" + hashlib.sha1(b"abc").hexdigest()
    data = _record(1, b"abc", ("WARC-Payload-Digest", good)) + _record(2, b"abd", ("WARC-Payload-Digest", good)) + _record(3)
    ids, gaps = _ids(data)
    assert ids == ["1", "3"] and len(gaps) == 1
    changed = _record(1, b"abc", ("WARC-Payload-Digest", good)).replace(b"\r\n\r\nabc", b"\r\n\r\nabX")
    assert _ids(changed + _record(4))[0] == ["4"]


def test_warc_search_is_linear():
    import time

    took = []
    for n in (1 << 14, 1 << 17):
        noise = (b"WARC/1.0\r\nname without end " + b"\x1f\x8b\x08zz") * n
        began = time.process_time()
        assert _ids(noise + _record(6))[0] == ["6"]
        took.append(time.process_time() - began)
    assert took[1] < 24 * max(took[0], 0.05)


def test_warc_quarantine_log_and_awkward_pages(spark, tmp_path):
    (tmp_path / "a.warc").write_bytes(_record(1) + b"noise" + _record(2))
    gaps = warc.quarantined(spark, f"file://{tmp_path}").collect()
    assert [(g.start, g.end) for g in gaps] == [(len(_record(1)), len(_record(1)) + 5)]
    big, huge = "x" * 1500, "y" * (9 << 20)
    rows = [(1, "u", big, 0), (2, "u", big, 0), (3, "u", big, 0), (None, "u", big, 0), (4, None, None, 0), (5, "u", huge, 0), (5, "u", huge, 0), (6, "u", "small", 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest long")
    got = sorted(((r.page_id or 0), r.record_type, r.refers_to or 0, r.payload_bytes) for r in warc.page_records(spark, pages).collect())
    assert got == [(0, "response", 0, 1500), (1, "revisit", 3, 1500), (2, "revisit", 3, 1500), (3, "response", 0, 1500), (4, "response", 0, 0), (5, "response", 0, 9 << 20), (5, "response", 0, 9 << 20), (6, "response", 0, 5)]


def test_mixing_rates_against_a_plain_solver(spark):
    rng = np.random.default_rng(2)
    p = rng.dirichlet([0.6, 0.4, 0.5], 60)
    tokens = rng.integers(5, 400, 60)
    book = spark.createDataFrame([(int(t), *map(float, x)) for t, x in zip(tokens, p)], "n_tokens long, p_a double, p_b double, p_c double")
    targets = {"a": 0.5, "b": 0.15, "c": 0.2}
    rate, _, reached = mixing.fit_rates(book, targets)
    got = np.array([r.rate for r in book.select(rate.alias("rate")).collect()])
    aim, r = np.array(list(targets.values())) * tokens.sum(), np.ones(60)
    scale = tokens / tokens.sum()
    for _ in range(200_000):  # the same problem, by small steps
        r = np.maximum(0, r - 0.5 * (p @ (((r * tokens) @ p - aim) / tokens.sum())))
    assert (got >= 0).all() and np.allclose(((got * tokens) @ p) / tokens.sum(), list(targets.values()), atol=2e-3)
    assert np.allclose(((r * tokens) @ p) / tokens.sum(), list(targets.values()), atol=2e-3)
    assert all(abs(reached[d] - x) < 2e-3 for d, x in targets.items()) and scale.sum() == pytest.approx(1)


def test_mixing_tells_of_targets_out_of_reach(spark):
    text = " ".join(_words(4, 40))
    docs = _clashing(spark, [(i, text) for i in range(8)] + [(None, text), (9, None), (10, "")])
    labels = spark.createDataFrame([(i, "a" if i % 2 else "b") for i in range(8)] + [(99, "a")], "doc_id long, domain string")
    with pytest.warns(UserWarning, match="in place of"):
        out = mixing.mix(spark, docs, labels, {"a": 0.9, "b": 0.1}).collect()
    assert len(out) == 11 and not any(r.target_met for r in out)


def test_decontamination_of_short_items_and_names(spark):
    item = "the old clock near Berlin shows 12 hours and then it stops for 3 minutes again"
    bench = spark.createDataFrame([(1, item), (2, "The"), (3, None), (None, "words"), (4, "")], "item_id long, text string")
    rows = [(1, "the cat sat on the mat"), (2, "x\nThe\ny"), (3, "Well, " + item.replace("12", "15")), (4, None), (5, ""), (None, item), (6, item), (6, item)]
    docs = _clashing(spark, rows)
    got = {(r.doc_id, r.item_id, r.exact, r.place) for r in decontam.contaminated(spark, docs, bench).collect()}
    assert got == {(2, 2, True, 1), (3, 1, False, 1), (6, 1, True, 0)}
    kept = decontam.drop_contaminated(spark, docs, bench)
    assert kept.columns == docs.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 4, 5]


def test_pii_mask_and_repeated_rows(spark):
    docs = _clashing(spark, [(1, "mail é@x a.b@c.de now"), (2, None), (None, "a.b@c.de"), (3, "clean"), (4, "10.0.0.1"), (4, "10.0.0.1")])
    found = pii.find(spark, docs)
    assert sorted((r.doc_id or 0, r.n_email, r.n_ip) for r in found.collect()) == [(0, 1, 0), (1, 1, 0), (2, 0, 0), (3, 0, 0), (4, 0, 1), (4, 0, 1)]
    masked = pii.mask(docs.filter("doc_id < 4"), found.filter("doc_id < 4"))
    assert masked.columns == docs.columns
    assert {r.doc_id: r.text for r in masked.collect()} == {1: "mail é@x <email> now", 2: None, 3: "clean"}


def test_pipeline_on_empty_and_awkward_documents(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    text = " ".join(_words(12, 80))
    rows = [(1, text, "en", "s", len(text)), (1, text, "en", "s", len(text)), (2, text, None, None, None), (None, " ".join(_words(13, 60)), "en", "s", 1), (3, None, "en", "s", 0), (4, "", "en", "s", 0), (5, " ".join(_words(14, 90)), "en", "s", 5)]
    spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id or 0) for r in out) == [0, 1, 5]
