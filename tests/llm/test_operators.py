"""Each operator against a brute-force version, and on rows that are awkward."""

import hashlib
import itertools
import math
import re
import zlib

import numpy as np
import pytest

from axonframe.llm import bytecnn, decontam, lattice, linedup, minhash, mixing, pii, quality, substring, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _prose(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join("".join(rng.choice(list("abcdefgh"), rng.integers(2, 7))) for _ in range(n))


def _docs(spark, rows):
    """Documents with extra columns of names that the operators use within."""
    return spark.createDataFrame([(i, t, lang, "s", 1, 2, "x") for i, t, lang in rows], "doc_id long, text string, lang string, source string, cid long, n long, rid string")


@pytest.fixture(scope="module")
def awkward(spark):
    base = _prose(1, 60)
    near = base.split()
    near[30] = "changed"
    rows = [(1, base, "en"), (2, " ".join(near), "en"), (3, base, None), (3, base, None), (4, None, "en"), (5, "", "de"), (6, " \n\t ", "de"), (7, "one two", "de"), (8, "One TWO", "fr"), (None, base, "en"), (9, _prose(2, 6000), "en"), (10, "x" * 50_000, "en"), (11, "\n".join([_prose(3, 12)] * 4 + [_prose(4, 9)]), "en"), (12, "é ß ñ mail a.b@c-d.org, 10.0.0.1 or 4539 1488 0343 6467 and +1 (212) 555-0199", "es")]
    return _docs(spark, rows)


@pytest.fixture(scope="module")
def nothing(spark):
    return _docs(spark, [])


def _shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_minhash_brute_force(spark, awkward, nothing):
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    for seed in range(40):  # a chain of near copies and some strangers
        rows.append((100 + seed, _prose(50 + seed // 8, 80).replace("a", "b", seed % 8 * 2)))
    docs = _docs(spark, [(i, t, "en") for i, t in rows])
    known = [(i, _shingles(t)) for i, t in rows if i is not None]
    root = {i: i for i, _ in known}
    for (a, x), (b, y) in itertools.combinations(known, 2):
        if x and y and 100 * len(x & y) >= 75 * len(x | y) and root[a] != root[b]:
            low, high = sorted((root[a], root[b]))
            root = {k: low if v == high else v for k, v in root.items()}
    got = minhash.near_duplicates(spark, docs).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is not None:
            assert r.component_id == root[r.doc_id] and r.kept == (r.doc_id == r.component_id)
    assert minhash.near_duplicates(spark, nothing).count() == 0


def test_quality_measures(awkward, nothing):
    for r in quality.apply_policy(quality.ledger(awkward.filter("doc_id <> 3 AND doc_id IS NOT NULL"))).collect():
        text = {x.doc_id: x.text for x in awkward.collect()}[r.doc_id] or ""
        words = WORD.findall(text)
        lines = [x for x in text.split("\n") if WORD.search(x)]
        windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
        covered = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 8)} if len(words) < 3000 else set()
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)))
        assert len(words) >= 3000 or r.n_repeat_words == len(covered)
        assert r.base_failed == (len(words) < 20 or 100 * r.n_repeat_words > 30 * len(words))
    assert quality.ledger(nothing).count() == 0
    assert quality.keep_clean(awkward).columns == awkward.columns
    book = quality.ledger(awkward)
    assert {r.rule for r in quality.ablations(book).collect()} == set(quality.RULES)


def test_lattice_sums_over_segmentations():
    pieces = [bytes([b]) for b in range(256)] + [b"ab", b" a", b"abc"]
    weights = np.log(np.arange(1, len(pieces) + 1) / np.arange(1, len(pieces) + 1).sum())
    table = dict(zip(pieces, np.exp(weights)))

    def brute(word):
        return table.get(word, 0.0) + sum(table.get(word[:k], 0.0) * brute(word[k:]) for k in range(1, len(word)))

    words = [np.frombuffer(w, np.uint8) for w in (b"abcab", b"a", b"zzz")]
    got = lattice.Lattice(pieces, weights).log_probabilities(words)[:, 0]
    assert np.allclose(got, [math.log(brute(b" " + w.tobytes())) for w in words])


def test_lattice_base_scores(spark, awkward, nothing):
    rows = [(r.doc_id, r.text or "") for r in awkward.collect()]
    out = [zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i, _ in rows]
    tokens = [[*WORD.findall(t.translate(LOWER)), "\n"] for _, t in rows]
    count = {}
    for held, own in zip(out, tokens):
        for w in own if not held else ():
            count[w] = count.get(w, 0) + 1
    n, v = sum(count.values()), len(count)
    want = sorted((i or -1, held, len(own), sum(w in count for w in own), n, round(sum(math.log10((count.get(w, 0) + 1) / (n + v + 1)) for w in own), 6)) for (i, _), held, own in zip(rows, out, tokens))
    got = lattice.score(spark, awkward).collect()
    assert sorted((r.doc_id or -1, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    assert lattice.score(spark, nothing).count() == 0


def test_substring_keeps_the_first(spark, awkward, nothing):
    passage = _prose(9, 40) + "."
    docs = _docs(spark, [(2, "First. " + passage, "en"), (1, passage + " Then more.", "en"), (3, "é " + _prose(11, 5) + ".", "en")])
    got = substring.repeated_passages(spark, docs).collect()
    assert [(r.doc_id, r.kept_doc_id, r.start) for r in got] == [(2, 1, 7)]
    cut = {r.doc_id: r for r in substring.drop_repeated_passages(spark, docs).collect()}
    assert cut[1].text == passage + " Then more." and _prose(9, 40) not in cut[2].text and cut[3].text.startswith("é")
    substring.repeated_passages(spark, awkward).collect()
    assert substring.repeated_passages(spark, nothing).count() == 0


def test_mixing_meets_targets(spark, awkward, nothing):
    docs = _docs(spark, [(i, ("good words here " if i % 3 else "bad spam now ") * (5 + i % 4), "en") for i in range(60)])
    labels = spark.createDataFrame([(i, "clean" if i % 3 else "junk") for i in range(30)], "doc_id long, domain string")
    rows = mixing.mix(spark, docs, labels, {"clean": 0.9, "junk": 0.1}).collect()
    total = sum(r.n_tokens for r in rows)
    assert abs(sum(r.rate * r.n_tokens * r.p_junk for r in rows) / total - 0.1) < 1e-3 and min(r.rate for r in rows) >= 0
    assert mixing.mix(spark, awkward, labels, {"clean": 0.9, "junk": 0.1}).count() == awkward.count()
    assert mixing.mix(spark, nothing, labels, {"clean": 0.9, "junk": 0.1}).count() == 0


def test_byte_network_reads_whole_texts_and_learns(spark, awkward, nothing):
    net = bytecnn.start()
    texts = [b"", b"a", b"abcdefgh" * 200, bytes(range(97, 122)) * 31]
    offs = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    got = bytecnn.features(np.frombuffer(b"".join(texts), np.uint8), offs, net, bytecnn._pairs(net))
    for t, x in zip(texts, got):
        data = np.frombuffer(t.ljust(bytecnn.WIDTH, b"\0"), np.uint8)
        value = bytecnn._windows(net["embed"][data]) @ net["filters"]
        top = np.stack([np.maximum(value[k : k + bytecnn.CHUNK].max(axis=0), 0) for k in range(0, len(value), bytecnn.CHUNK)])
        assert np.allclose(x, np.concatenate([top.mean(axis=0), top.max(axis=0)]), atol=1e-4)
    docs = _docs(spark, [(i, _prose(i, 30) if i % 2 else _prose(i, 30).upper(), "en") for i in range(120)])
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(120)], "doc_id long, quality int, toxic int")
    rows = [r for r in bytecnn.classify(spark, docs, labels).collect() if r.held_out]
    assert sum(r.predicted == r.doc_id % 2 for r in rows) >= 0.9 * len(rows)
    out = bytecnn.classify(spark, awkward, labels).collect()
    assert len(out) == awkward.count() and all(0 <= r.score <= 1 for r in out)
    assert bytecnn.classify(spark, nothing, labels.limit(0)).count() == 0


def test_decontamination_finds_changed_values(spark, awkward, nothing):
    item = "A train leaves the station with 40 passengers and drops 12 kg of mail at every stop before noon"
    bench = spark.createDataFrame([(7, item), (8, None)], "item_id long, text string")
    docs = _docs(spark, [(1, "Look. " + item.replace("40", "55").replace("12", "9") + " ok", "en"), (2, _prose(5, 50), "en"), (3, None, "en")])
    got = decontam.contaminated(spark, docs, bench).collect()
    assert [(r.doc_id, r.item_id, r.exact) for r in got] == [(1, 7, False)]
    assert decontam.contaminated(spark, awkward, bench).count() == 0 and decontam.contaminated(spark, nothing, bench).count() == 0


def _base_spans(text):
    email = [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    ip = [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m.group().split("."))]
    luhn = lambda d: sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0
    card = [m.span() for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 13 <= len(d := re.sub("[ -]", "", m.group())) <= 19 and luhn(d)]
    phone = [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return email, ip, card, phone


def test_pii_patterns_are_the_plain_ones(spark, awkward, nothing):
    rng = np.random.default_rng(3)
    parts = ["a@b.c", "@", ".", "1.2.3.4", "300.1.1.1.1", "4111 1111 1111 1111", "4539148803436467", "+1 (212) 555-0199", "+49 ", "x", " ", "-", "a.b@c.d@e.f", "9", "\n"]
    for _ in range(3000):
        text = "".join(rng.choice(parts, rng.integers(1, 9)))
        assert tuple(pii.patterns(text)) == _base_spans(text), text
    for r in pii.find(spark, awkward.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"])).collect():
        text = {x.doc_id: x.text for x in awkward.collect()}[r.doc_id] or ""
        spans = _base_spans(text)
        flat = ",".join(f"{k}:{a}:{b}" for k, own in zip(pii.KINDS, spans) for a, b in own)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(map(len, spans)) and r.base_sha256 == hashlib.sha256(flat.encode()).hexdigest()
    assert pii.find(spark, nothing).count() == 0


def test_field_is_right_on_new_sentences_and_viterbi_is_exact():
    field = pii.train()
    table = pii.labelled_table(200, seed=77)
    raw = [" ".join(w).encode() for w, _ in table]
    data, offs = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    starts, ends, at = pii.find_words(data, offs)
    row = np.repeat(np.arange(len(table)), np.diff(at))
    emit = field.emissions(pii._word_codes(data, starts, ends), row)
    got = field.decode(emit, at)
    gold = np.array([pii.LABELS.index(x) for _, own in table for x in own])
    assert (got == gold).mean() > 0.98
    for k in range(40):  # without the shortcut for plain lines, a line at a time
        e = emit[at[k] : at[k + 1]]
        score, back = field.moves[0] + e[0], []
        for x in e[1:]:
            ways = score[:, None] + field.moves
            back.append(ways.argmax(axis=0))
            score = ways.max(axis=0) + x
        path = [int(score.argmax())]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        assert path[::-1] == got[at[k] : at[k + 1]].tolist()


def test_line_dedup_brute_force(spark, awkward, nothing):
    rng = np.random.default_rng(8)
    vocab = [f"w{i}" for i in range(40)]
    lines = [list(rng.choice(vocab, 10, replace=False)) for _ in range(30)]
    rows = []
    for i in range(25):
        own = []
        for _ in range(6):
            line = list(lines[rng.integers(30)])
            for _ in range(rng.integers(0, 3)):
                line[rng.integers(len(line))] = vocab[rng.integers(40)]
            own.append(" ".join(line))
        rows.append((i, "\n".join(own), "en"))
    every = [(i, k, frozenset(line.split())) for i, t, _ in rows for k, line in enumerate(t.split("\n"))]
    want = {(i, k) for p, (i, k, s) in enumerate(every) if len(s) >= 5 and any(len(o) >= 5 and 100 * len(s & o) >= 75 * len(s | o) for _, _, o in every[:p])}
    got = linedup.repeated_lines(spark, _docs(spark, rows)).collect()
    assert {(r.doc_id, r.line_no) for r in got} == want
    kept = linedup.drop_repeated_lines(spark, awkward)
    assert kept.columns == awkward.columns and kept.filter("doc_id = 11").first().text.count("\n") == 1
    assert linedup.repeated_lines(spark, nothing).count() == 0


def test_warc_round_trip_and_salvage(spark):
    big = "é" * 800
    pages = spark.createDataFrame([(1, "http://a", big), (2, "http://b", big), (3, "u", "small"), (4, "u", "small"), (5, None, None), (6, "x\r\ny", "")], "page_id long, url string, html string")
    got = {r.page_id: r for r in warc.page_records(spark, pages).collect()}
    assert len(got) == 6 and got[1].record_type == "revisit" and got[1].refers_to == 2 and got[2].record_type == "response"
    assert got[1].payload_bytes == 1600 and got[1].payload_digest == hashlib.sha1(big.encode()).hexdigest() and got[4].record_type == "response"
    assert warc.page_records(spark, pages.limit(0)).count() == 0
    records = [warc.zipped(warc.pack(warc.VERSION, [("WARC-Type", "response"), ("WARC-Record-ID", f"<urn:page:{k}>")], b"HTTP/1.1 200 OK\r\n\r\nbody%d" % k)) for k in range(4)]
    damaged = records[0] + records[1][:-12] + b"\xff" * 9 + records[2] + b"junk" + records[3]
    found = list(warc.salvage(damaged))
    assert [h["warc-record-id"][-2] for kind, _, _, h, _ in found if kind == "record"] == ["0", "2", "3"]
    gaps = [(a, b) for kind, a, b, _, _ in found if kind == "gap"]
    assert gaps[0] == (len(records[0]), len(records[0]) + len(records[1]) - 3) and len(gaps) == 2


def test_pipeline_keeps_columns(spark, tmp_path):
    import corpus_pipeline

    docs = _docs(spark, [(i, "\n".join(_prose(i * 7 + k, 40) for k in range(3)), "en") for i in range(20)] + [(50, "too short", "en")]).select("doc_id", "text", "lang", "source").selectExpr("*", "cast(length(text) as long) AS n_chars")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(10)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, _prose(7, 40))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    ids = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert 50 not in ids and 1 not in ids and len(ids) >= 15


def test_minhash_links_contained_texts(spark):
    rows = []
    for pair, (few, many) in enumerate([(60, 80), (64, 85), (70, 93), (75, 100), (64, 80), (64, 86)] * 6):
        words = _prose(900 + pair, many + 4).split()
        rows += [(2 * pair, " ".join(words[: few + 4]), "en"), (2 * pair + 1, " ".join(words), "en")]
    sets = {i: _shingles(t) for i, t, _ in rows}
    similar = {i for i in range(0, len(rows), 2) if 100 * len(sets[i] & sets[i + 1]) >= 75 * len(sets[i] | sets[i + 1])}
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark, _docs(spark, rows)).collect()}
    assert len(similar) == 30 and {i for i in got if i % 2 and got[i] == i - 1} == {i + 1 for i in similar}


def test_substring_covers_every_run_of_50_words(spark):
    a, b, c = (_prose(700 + k, n).split() for k, n in enumerate((50, 52, 130)))
    stray = itertools.count(800)
    own = lambda n: _prose(next(stray), n).split()
    wrap = lambda words: "\n".join(" ".join(words[k : k + 7]) for k in range(0, len(words), 7))
    texts = [" ".join(own(9) + a + own(30)), " ".join(own(30) + a + own(3)), wrap(own(11) + b + own(20)), wrap(own(4) + b + own(40)), " ".join(own(5) + c[20:90] + own(30) + c[100:]), wrap(c), " ".join(own(20) + c[35:] + own(9)), " ".join(own(2) + b[1:] + own(30)), " ".join(own(3) + c[40:58] + own(40))]
    words = [t.split() for t in texts]
    seen, want = set(), []
    for i, w in enumerate(words):
        windows = [tuple(w[k : k + 50]) for k in range(len(w) - 49)]
        want += [(i, k + m) for k, x in enumerate(windows) if x in seen for m in range(50)]
        seen |= set(windows)
    docs = _docs(spark, [(i, t, "en") for i, t in enumerate(texts)])
    got = set()
    for r in substring.repeated_passages(spark, docs).collect():
        first, n = len(texts[r.doc_id][: r.start].split()), len(texts[r.doc_id][r.start : r.end].split())
        kept = len(texts[r.kept_doc_id][: r.kept_start].split())
        assert words[r.doc_id][first : first + n] == words[r.kept_doc_id][kept : kept + n] and n == r.n_words
        got |= {(r.doc_id, first + k) for k in range(n)}
    assert {i for i, _ in want} == {1, 3, 5, 6, 7} and set(want) <= got and not any(i in (0, 2, 4, 8) for i, _ in got)


def test_line_dedup_takes_short_lines(spark):
    lines = ["one", "two three", "a b c", "a b c d", "a b c d e", "buy now buy now buy now", "", "Three TWO", "ONE", "c b a", "d c b a", "now buy", "alone here", " ", "one two", "a b x"]
    rows = [(i, "\n".join(lines[i * 4 : i * 4 + 4]), "en") for i in range(4)]
    every = [(i, k, _shingle_words(line)) for i, t, _ in rows for k, line in enumerate(t.split("\n"))]
    want = {(i, k) for p, (i, k, s) in enumerate(every) if s and any(100 * len(s & o) >= 75 * len(s | o) for _, _, o in every[:p] if o)}
    got = linedup.repeated_lines(spark, _docs(spark, rows)).collect()
    assert {(r.doc_id, r.line_no) for r in got} == want and len(want) == 7


def _shingle_words(line):
    return frozenset(line.lower().split())
