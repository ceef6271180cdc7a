"""Operators on documents against brute force, and on odd rows and empty tables."""

import hashlib
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from .conftest_llm import LOW, brute_components, brute_repeats, shingles

from tallyfin.llm import bpe, common, decontam, licences, linededup, minhash, pii, quality, repeats
from tallyfin.llm import graph
from tallyfin.llm.graph import components

from .conftest import ODD


def both(corpus):
    return corpus + ODD


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (3, 3), (5, 4), (4, 6), (6, 5), (2, 1), (None, 4), (10, 1)]
    edges += [(100, i) for i in range(101, 160)] + [(i, i + 1) for i in range(200, 230)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got[3] == 1 and got[10] == 1 and got[9] == 8 and got[6] == 4 and got[159] == 100 and got[230] == 200
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("k", [4, 5])
def test_near_duplicates(frame, corpus, k):
    rows = both(corpus)
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(frame(rows), k).collect())
    comp = brute_components([(i, t) for i, t in rows if i is not None], k)
    want = sorted((i is None, i or 0, len(shingles(t, k)), comp[i] if i is not None else None, comp[i] == i if i is not None else None) for i, t in rows)
    assert got == want


def test_many_near_copies_in_blocks(frame, corpus, monkeypatch):
    """A cluster over several blocks gives the same components."""
    monkeypatch.setattr(minhash, "BLOCK_WEIGHT", 3000)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(frame(corpus), 4).collect()}
    assert got == brute_components(corpus, 4)


def test_near_duplicates_of_repeated_ids(frame, corpus):
    """A document of several texts has the links of each; rows without words are their document's too."""
    rng = __import__("random").Random(3)
    a, b, c = (" ".join(f"{x}{rng.randrange(10**6)}" for _ in range(60)) for x in "abc")
    rows = corpus + [(505, a), (505, b), (509, b + " more"), (510, c), (511, c), (511, a + " end"), (512, c + " end"), (505, ""), (520, ""), (520, b), (521, None), (522, a), (522, a), (3, c)]
    for hot in (False, True):
        with pytest.MonkeyPatch.context() as patch:
            if hot:  # keys and hubs of more than one row go the way of hot ones
                for module, name, value in ((common, "HOT", 10**9), (common, "HOT_ROWS", 1), (graph, "HUBS", 1000), (graph, "HOT_ROWS", 1)):
                    patch.setattr(module, name, value)
            got = sorted((r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(frame(rows), 4).collect())
        comp = brute_components(rows, 4)
        assert comp[509] == comp[505] == comp[512] == comp[520] == 3 and comp[521] == 521
        assert got == sorted((i, comp[i], comp[i] == i) for i, _ in rows)


def test_near_duplicates_of_nothing(frame):
    assert minhash.near_duplicates(frame([])).count() == 0
    assert [r.kept for r in minhash.near_duplicates(frame([(1, "a b c d e f")])).collect()] == [True]


def test_sketch_fills_and_estimates():
    import numpy as np

    a = np.arange(1, 1001, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    one, other = minhash.sketch(a[:900]), minhash.sketch(a[100:])
    assert abs((one == other).mean() - 0.8) < 0.12
    for n in (1, 2, 5, 40):
        assert len(set(minhash.sketch(a[:n]).tolist())) > 1 and (minhash.sketch(a[:n]) == minhash.sketch(a[:n])).all()


def test_line_dedup(frame, corpus):
    rows = both(corpus)
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOW)
    held = defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            if i is not None and len(key(x)) >= 40:
                held[key(x)].add(i)
    gone = {k: max(v) for k, v in held.items() if len(v) >= 5}
    assert gone
    want = Counter()
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or key(x) not in gone or gone[key(x)] == i]
        want[i, len(lines), len(lines) - len(kept), "\n".join(kept)] += 1
    got = Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in linededup.dedup_lines(frame(rows)).collect())
    assert got == want
    assert linededup.dedup_lines(frame([])).count() == 0


def test_line_dedup_by_shuffled_keys(frame, corpus, monkeypatch):
    """Beyond the number of keys that are broadcast, hot keys and others give the same."""
    want = sorted(map(str, linededup.dedup_lines(frame(both(corpus))).collect()))
    monkeypatch.setattr(linededup, "MOST_KEYS", 0)
    monkeypatch.setattr(common, "HOT", 2)
    monkeypatch.setattr(common, "HOT_ROWS", 1)
    assert sorted(map(str, linededup.dedup_lines(frame(both(corpus))).collect())) == want


def test_line_dedup_of_very_many_lines(frame, corpus):
    """Time is linear in a document's lines; a line that one document repeats does not count as one of many documents."""
    import time

    lines = [f"line {k % 199_000} of one long document, each more than forty characters" for k in range(200_000)]
    df = frame([(1, "\n".join(lines)), (2, "\n".join(lines[:10])), (3, "x"), *((k, lines[5]) for k in (4, 5, 6))])
    start = time.perf_counter()
    got = {r.doc_id: r for r in linededup.dedup_lines(df).collect()}
    assert time.perf_counter() - start < 60
    assert got[1].n_lines == 200_000 and got[1].n_dropped == 2 and got[2].n_dropped == 1 and got[6].n_dropped == 0 and got[5].n_dropped == 1
    assert got[1].kept == "\n".join(x for x in lines if x != lines[5])


def test_folded_lines(spark):
    import random

    rng = random.Random(1)
    letters = "abAB éÉàÀßẞİıΣςσКк\u212a×÷ÿŸ日🙂ÐðÞþ"
    found = {"".join(rng.choice(letters) for _ in range(rng.randrange(1, 4))) for _ in range(3000)} | {"\u00c3\u0089", "\u00e3\u0089", "\u00c9"}
    df = spark.createDataFrame([(x,) for x in found], "x string")
    classes = df.groupBy(linededup.folded(F.col("x"))).agg(F.collect_set("x")).collect()
    assert sorted(sorted(r[1]) for r in classes) == sorted(sorted(x for x in found if x.translate(LOW) == y) for y in {x.translate(LOW) for x in found})


def test_repeats(frame, corpus):
    rows = both(corpus) + [(95_001, "ab" * 200), (95_002, "ab" * 150 + "c"), (95_003, "q" * 49), (95_004, "q" * 49), (95_005, "q" * 50)]
    want = brute_repeats(rows)
    for block_bytes in (3000, 1 << 20):
        got = Counter((r.doc_id, r.n_bytes, len(r.spans), bytes(r.kept)) for r in repeats.remove_repeats(frame(rows), block_bytes=block_bytes).collect())
        assert got == want
    # codes of several phrases count as hot: their strings go by themselves
    got = Counter((r.doc_id, r.n_bytes, len(r.spans), bytes(r.kept)) for r in repeats.remove_repeats(frame(rows), block_bytes=3000, told_from=2, hot_phrases=3).collect())
    assert got == want
    assert repeats.remove_repeats(frame([])).count() == 0


def test_repeats_of_many_null_ids(frame, corpus):
    """Rows without an id are no block of their own: they are returned as they are, whatever their number."""
    text = corpus[7][1]
    rows = [(None, text)] * 3000 + [(None, None), (1, text), (2, text)]
    df = frame(rows)
    got = Counter((r.doc_id, r.n_bytes, len(r.spans), bytes(r.kept)) for r in repeats.remove_repeats(df).collect())
    assert got == brute_repeats(rows)
    assert repeats.remove_repeats(df.filter("doc_id is null")).count() == 3001


def test_bpe(frame, corpus):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    tiktoken = pytest.importorskip("tiktoken")
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    rows = both(corpus) + [(96_001, "<|endoftext|> " + "ab" * 4000), (96_002, "\n" * 700 + "a"), (96_003, "=-" * 2000), (96_004, "".join(map(chr, range(1, 700))) * 2), (96_005, "".join(map(chr, range(1, 256)))), (96_006, " a\x1c b\x85 ²½x\xa0 ª\x1f")]
    want = Counter((i, tuple(enc.encode_ordinary(t or ""))) for i, t in rows)
    got = bpe.encode_documents(frame(rows), path, public_tokenizers.PATTERN).collect()
    assert Counter((r.doc_id, tuple(r.ids)) for r in got) == want
    assert Counter((r.doc_id, bytes(r.decoded)) for r in got) == Counter((i, (t or "").encode()) for i, t in rows)
    empty = next(r for r in bpe.digests(bpe.encode_documents(frame([(1, None)]), path, public_tokenizers.PATTERN)).collect())
    assert empty.n_tokens == 0 and empty.ids_sha256 == hashlib.sha256(b"").hexdigest() == empty.decoded_sha256


def test_decontamination(spark, frame, corpus):
    items = [(1, corpus[4][1]), (2, " ".join(corpus[7][1].split()[3:40])), (3, "zeta " * 3), (4, "one"), (5, None), (6, ""), (7, " ".join(corpus[121][1].split()[:90])), (7, "one")]
    rows = both(corpus)

    def words(t):
        return re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW))

    def sets(w, n):
        return {tuple(w[j : j + n]) for j in range(len(w) - n + 1)}

    want = Counter()
    for item, text in items:
        w = words(text)
        if w:
            n = min(5, len(w))
            s = sets(w, n)
            for i, t in rows:
                shared = len(s & sets(words(t), n))
                if shared >= 0.8 * len(s) - 1e-9 and shared:
                    want[i, item, shared, len(s)] += 1
    bench = spark.createDataFrame(items, "item_id long, text string")
    with pytest.MonkeyPatch.context() as patch:  # many blocks, several to a pass
        patch.setattr(decontam, "BLOCK_BYTES", 100)
        patch.setattr(decontam, "PASS", 2)
        assert Counter((r.doc_id, r.item_id, r.n_shared, r.n_item) for r in decontam.find_contamination(frame(rows), bench).collect()) == want
        assert decontam.drop_contaminated(frame(rows), bench).count() == sum(not any(k[0] == i for k in want) for i, _ in rows)
    got = Counter((r.doc_id, r.item_id, r.n_shared, r.n_item) for r in decontam.find_contamination(frame(rows), bench).collect())
    assert got == want and want
    clean = decontam.drop_contaminated(frame(rows), bench)
    assert clean.columns == frame(rows).columns
    assert Counter(r.doc_id for r in clean.collect()) == Counter(i for i, _ in rows if not any(k[0] == i for k in want))
    assert decontam.find_contamination(frame([]), bench).count() == 0
    assert decontam.find_contamination(frame(rows), bench.limit(0)).count() == 0


def test_licences(frame, corpus):
    mit = licences.TEMPLATES["mit"][0]
    rows = both(corpus) + [(97_001, "Code. " + mit + " end"), (97_002, "All Rights Reserved; cc-by and CC  BY cc by"), (97_003, mit[:120]), (97_004, "GNU General Public License")]
    got = {r.doc_id: r for r in licences.scan_licences(frame(rows)).collect() if r.doc_id is not None}
    assert got[97_001].labels == "mit" and got[97_001].base_labels == "" and got[97_001].score == 1
    assert (got[97_002].n_base, got[97_002].first_word, got[97_002].last_word, got[97_002].base_labels) == (4, 0, 8, "cc-by,reserved")
    assert got[97_003].labels == "" and got[97_004].base_labels == "gpl"
    assert got[90_001].n_words == 0 and got[90_001].first_word is None and got[90_001].score == 0
    assert len(licences.scan_licences(frame(rows)).collect()) == len(rows) and licences.scan_licences(frame([])).count() == 0


def test_licences_by_brute_force(corpus):
    """Phrases by comparing words, maximal matches by trying every run of words; chains have a test of their own."""
    import random

    rng = random.Random(2)
    scanner = licences.Scanner()
    words_of = lambda t: [w.decode() for w in re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.encode().lower())]
    templates = [(label, words_of(t)) for label, ts in licences.TEMPLATES.items() for t in ts]
    least, runs = licences.MIN_MATCH, [{} for _ in templates]
    for k, (_, t) in enumerate(templates):
        for a in range(len(t)):
            for b in range(a + least, len(t) + 1):
                runs[k].setdefault(tuple(t[a:b]), set()).add(a)
    texts = [t for _, t in corpus[:20]] + [None or "", "All Rights Reserved cc by cc BY; cc-by all rights reserved " * 3]
    for _ in range(60):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            t = rng.choice(templates)[1]
            a = rng.randrange(len(t)) if rng.random() < 0.5 else 0
            piece = list(t[a : a + rng.randrange(3, 80)])
            if rng.random() < 0.6:
                piece[rng.randrange(len(piece))] = "changed"
            parts += piece + ["word"] * rng.randrange(3)
        texts.append(", ".join(parts).title())
    seen = 0
    for text in texts:
        w = words_of(text)
        n_words, n_base, first, last, base, labels, score, spans = scanner.scan(text)
        places = sorted(i for phrase in licences.PHRASES for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split())
        named = {label for phrase, label in licences.PHRASES.items() if any(w[i : i + len(phrase.split())] == phrase.split() for i in places)}
        assert (n_words, n_base, first, last, base) == (len(w), len(places), places[0] if places else None, places[-1] if places else None, ",".join(sorted(named)))
        claims = []
        for k, (label, t) in enumerate(templates):
            matches = []
            for i in range(len(w)):
                ends = [j for j in range(min(len(w), i + len(t)), i + least - 1, -1) if tuple(w[i:j]) in runs[k]]
                if ends and not (i and tuple(w[i - 1 : ends[0]]) in runs[k]):  # the longest from here, and no longer to the left
                    matches += [(i, ends[0], a) for a in runs[k][tuple(w[i : ends[0]])]]
            claims += [(-n, -n / len(t), k, a, b) for n, a, b in licences.chains(matches, len(t), licences.COVER * len(t))]
        want, taken = [], set()
        for n, share, k, a, b in sorted(claims):
            if 2 * len(taken & set(range(a, b))) < b - a:
                taken |= set(range(a, b))
                want.append((templates[k][0], a, b, -share))
        assert sorted((s["label"], s["first_word"], s["end_word"], s["cover"]) for s in spans) == sorted(want)
        assert labels == ",".join(sorted(named | {x[0] for x in want})) and score == max([0.0, *(x[3] for x in want), *([1.0] if named else [])])
        seen += len(want)
    assert seen > 20


def test_phrases_in_linear_time():
    import time

    start = time.monotonic()
    assert licences.Scanner().scan("cc by " * 300_000)[1] == 300_000
    assert time.monotonic() - start < 20


def test_automaton():
    a = licences.Automaton([[1, 2, 3, 1, 2, 4], [5, 2, 3]])
    assert [(s, e) for s, e, _ in a.matches([9, 1, 2, 3, 1, 2, 4, 5, 2, 3], 3)] == [(1, 7), (7, 10)]


def _luhn(s):
    return sum(int(c) if k % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for k, c in enumerate(reversed(s))) % 10 == 0


def test_personal_data(frame, corpus):
    cases = ["a@b.c_d@e.f x@y", "1.2.3.4.5.6.7.8 999.1.1.1 0255.1.1.1 x1.1.1.1", "é 4111 1111 1111 1111 4111-1111-1111-1112 " + "9 " * 60, "+1 (017) 555-7713. +12345678901234567 ++49 30 123456 é+1-2", "1.2.3.4@x.y.z a@b.c@d.e..f@g.h- +123-4567-8( 9 a@@b.c"]
    rows = both(corpus) + [(98_000 + k, c) for k, c in enumerate(cases)]
    rows += [(98_100 + k, f"patient id: user{k}@mail.example.com end") for k in range(6)] + [(98_200, "patient id: QX-99812-77, end"), (98_201, "nothing here: QX-99812-78 end")]
    digits = lambda v: re.sub("[^0-9]", "", v)
    spec = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda v: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda v: all(int(p) <= 255 for p in v.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda v: 16 <= len(digits(v)) <= 19 and _luhn(digits(v))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: 8 <= len(digits(v)) <= 15),
    }
    want = Counter()
    for i, t in rows:
        found = [(k, m.start(), m.end()) for k, (e, ok) in spec.items() for m in re.finditer(e, t or "") if ok(m[0])]
        said = ",".join(f"{k}:{a}:{b}" for k, a, b in found)
        want[(i, *(sum(x[0] == k for x in found) for k in spec), hashlib.sha256(said.encode()).hexdigest())] += 1
    got = pii.find_personal_data(frame(rows)).collect()
    assert Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got) == want
    spans = {r.doc_id: r.spans for r in got}
    assert spans[98_200] == "email:12:23" and spans[98_201] == ""
    assert pii.find_personal_data(frame([])).count() == 0


def test_quality(spark, frame, corpus):
    junk = [(1000 + i, " | ".join(t.split())) if i % 2 else (1000 + i, re.sub(r"(\w+)", r"\1###", t)) for i, t in corpus]
    rows = corpus + junk + ODD
    labels = spark.createDataFrame([(i, 1) for i, _ in corpus] + [(i, 0) for i, _ in junk] + [(5, None), (None, 1)], "doc_id long, quality int")
    got = quality.classify(frame(rows), labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 2000 and len(dict(rows)[r.doc_id].split()) > 3]
    assert held and sum(r.predicted == (r.doc_id < 1000) for r in held) / len(held) > 0.9
    import zlib

    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got if r.doc_id is not None)
    assert {r.score for r in quality.classify(frame(rows[:3]), labels.limit(0)).collect()} and quality.classify(frame([]), labels).count() == 0


def test_features_by_brute_force(corpus):
    """Statistics counted character by character; slots and values word by word."""
    import numpy as np

    from tallyfin.llm.common import text_pieces, word_hashes
    import pyarrow as pa

    texts = [t for _, t in corpus[:40]] + ["", None, "A! b| c| #$%\n\n12, Zeit. éß;", "!!!\t???", "x" * 500]
    got = [f for _, _, data, offsets in text_pieces(pa.array(texts)) for f in quality.features(data, offsets, [None] * len(texts))]
    for text, (slots, x) in zip(texts, got):
        raw = (text or "").encode()
        words = re.findall(rb"[^\x20\x09-\x0D]+", raw)
        of = lambda chars: sum(b in chars for b in raw)
        lines, size, n = raw.count(b"\n") + 1, max(1, len(raw)), max(1, len(words))
        symbols, pipes, bangs = of(b"#$%&*@^~_+=<>\\{}[]"), of(b"|"), of(b"!?")
        by_slot = Counter()
        for w in words:
            one = np.frombuffer(w, np.uint8)
            by_slot[int(word_hashes(one, np.array([0, len(one)]))[0][0] >> np.uint64(51))] += 1
        want = {
            "log_chars": np.log1p(len(raw)) / 10, "log_words": np.log1p(len(words)) / 10, "mean_word": min(4, (len(raw) - of(b" \t\x0b\x0c\r")) / n / 10), "symbols": min(4, 10 * symbols / size),
            "digits": 10 * of(b"0123456789") / size, "upper": 3 * of(bytes(range(65, 91))) / size, "pipes": min(4, 20 * pipes / size), "bangs": min(4, 20 * bangs / size), "symbols_per_word": min(4, symbols / n),
            "lines": min(4, 10 * lines / n), "short_lines": float(len(raw) / lines < 30), "stops": min(4, 5 * of(b".") / n), "commas": min(4, 5 * of(b",;:") / n), "high_bytes": 2 * of(range(128, 256)) / size,
            "repeated_words": 1 - len(by_slot) / n, "inner_symbols": min(4, (symbols + pipes + bangs) / n), "log_metadata_chars": np.log1p(len(raw)) / 10, "empty": float(not words),
        }
        assert dict(zip(quality.STATISTICS, x[: quality.N_STATS])) == pytest.approx(want)
        length = np.sqrt(sum(np.log1p(c) ** 2 for c in by_slot.values())) or 1
        assert dict(zip((slots[quality.N_STATS :] - quality.N_STATS).tolist(), x[quality.N_STATS :])) == pytest.approx({s: quality.WORD_LENGTH * np.log1p(c) / length for s, c in by_slot.items()})


def test_sample_holds_an_id_once(spark, frame, monkeypatch):
    fitted = []
    monkeypatch.setattr(quality.Machine, "fit", lambda self, rows, labels, **k: fitted.append((len(rows), labels)) or self)
    labels = spark.createDataFrame([(k, k % 2) for k in range(12)], "doc_id long, quality int")
    quality.train(frame([(3, f"text {k}") for k in range(500)] + [(k, "other") for k in range(12)]), labels)
    assert fitted[0][0] == len(fitted[0][1]) <= 12


def test_interactions_by_squares():
    """The linear-time identity equals the sum over pairs."""
    import numpy as np

    m = quality.Machine(size=30, rank=3)
    m.v, m.w, m.b = np.random.default_rng(1).normal(size=(30, 3)), np.arange(30) / 30, 0.2
    slots, x = np.array([1, 4, 9, 20]), np.array([0.5, 1.0, -2.0, 0.25])
    pairs = sum(m.v[a] @ m.v[b] * x[i] * x[j] for i, a in enumerate(slots) for j, b in enumerate(slots) if i < j)
    assert m.margin(slots, x)[0] == pytest.approx(0.2 + m.w[slots] @ x + pairs)


def test_personal_data_beyond_the_base(frame):
    """Learned contexts add keys, numbers in brackets and addresses without a dot, whole; the same shapes elsewhere stay."""
    rows = [(k, f'x token = "{"%040x" % (0xABCDEF0123456789 * (k + 3) ** 9 % (1 << 160) | 0xA << 156)}" y call me: +49 30 55{k}1234 now, write to: u{k}@m{k}.example.com.') for k in range(6)]
    rows += [(20, 'x token = "ZZ-9911-xy77" y'), (21, "call me: (555) 123-4567, now"), (22, "write to: root@intranet."), (23, "call me: 030 123 4567 now")]
    rows += [(30, 'version = "ZZ-9911-xy78" y'), (31, "rows (555) 123-4568, now"), (32, "see root@intranets."), (33, "1 of 030 123 4568 now")]
    spans = {r.doc_id: r.spans for r in pii.find_personal_data(frame(rows)).collect()}
    text = dict(rows)
    said = {i: [(s.split(":")[0], text[i][int(s.split(":")[1]) : int(s.split(":")[2])]) for s in v.split(",") if s] for i, v in spans.items()}
    assert said[20] == [("secret", "ZZ-9911-xy77")] and said[21] == [("phone", "(555) 123-4567")] and said[22] == [("email", "root@intranet")] and said[23] == [("phone", "030 123 4567")]
    assert [k for k, _ in said[3]] == ["email", "phone", "secret"] and all(said[i] == [] for i in (30, 31, 32, 33))


def test_scores_by_brute_force(spark):
    import random
    from math import prod

    rng = random.Random(4)
    mentions = [(rng.choice(["email", "phone", "secret", None, None]), f"i{rng.randrange(25)}", f"c{rng.randrange(8) ** 2 % 11}") for _ in range(400)]
    mentions += [("email", f"e{k}", "ca") for k in range(9)] + [(None, "new", "ca"), (None, "new", "c0"), ("phone", "p", "ca"), ("phone", "p", "cb"), (None, "other", "cb")]
    weight = Counter(mentions)
    learned, accepted = Counter(), None
    for _ in range(pii.TURNS):
        seeds = {(c, k): len({i for kk, i, cc in weight if (kk, cc) == (k, c)}) for k, _, c in weight if k}
        precision = {}
        for c, k in seeds:
            mass = sum(n for (kk, _, cc), n in weight.items() if (kk, cc) == (k, c)) + learned[c, k]
            share = mass / sum(n for (_, _, cc), n in weight.items() if cc == c)
            if seeds[c, k] >= pii.SEEDS and share >= (pii.PRECISION if accepted is not None else pii.PRECISION / 2):
                precision[c, k] = share
        reached = [(i, c, n, kk) for (k, i, c), n in weight.items() if k in (None, "secret") for cc, kk in precision if cc == c]
        accepted = {(i, k): 1 - prod(max(1e-9, 1 - precision[c, k]) for ii, c, _, kk in reached if (ii, kk) == (i, k)) for i, _, _, k in reached}
        learned = Counter()
        for i, c, n, k in reached:
            learned[c, k] += n * accepted[i, k]
    best = {}
    for (i, k), v in accepted.items():
        if v >= pii.PRECISION:
            best[i] = max(best.get(i, (0, "")), (v, k))
    got = {r.instance: r.kind for r in pii._discover(spark.createDataFrame(mentions, "kind string, instance string, context string")).collect()}
    assert got == {i: k for i, (_, k) in best.items()} and got["new"] == "email" and "other" not in got


def test_personal_data_in_a_long_text(frame):
    """More matches than a run holds, in time linear in the text."""
    import time

    text = " ".join(f"é 10.0.{k % 256}.{k % 199} a{k}@b.cd;" for k in range(30_000))
    start = time.monotonic()
    row = pii.find_personal_data(frame([(1, text)])).collect()[0]
    want = [f"{kind}:{m.start()}:{m.end()}" for kind, e in (("email", r"a[0-9]+@b\.cd"), ("ip", r"10\.0\.[0-9.]+")) for m in re.finditer(e, text)]
    assert row.n_ip == row.n_email == 30_000 and row.spans == ",".join(want) and time.monotonic() - start < 60
