"""Token counts, vector codes and spelling variants against the library, int64 arithmetic and brute force."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tallyfin.llm import spelling, tokencount, vqcode
from tests.llm.conftest import ODD
from tests.llm.conftest_llm import LOW


def rows_of(df):
    return Counter(tuple(r) for r in df.collect())


# Token counts


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokencount.default_tokenizer())
    return lambda text: len(tokenizer.encode(text or "", add_special_tokens=False))


SPECIAL = [
    (700, "a <|endoftext|> b<|endoftext|><|endoftext|>c"), (701, "<|endoftext|>"), (702, "<|endoftext|"), (703, "it's we'll I'M  two   three \n\n four\t\tfive "),
    (704, "ab \x1c\x85 　 x   y"), (705, "\U00010940\U00010941 ՘ ࢏ old and new letters " * 5), (None, "null id"), (None, None), (706, "日本語のテキスト" * 50),
]


def test_token_counts_equal_the_library(spark, frame, corpus, library, tmp_path):
    rows = corpus + ODD + SPECIAL
    got = rows_of(tokencount.count_tokens(frame(rows), tokencount.default_tokenizer(), str(tmp_path / "cache")))
    want = Counter((i, len((t or "").encode()), n := library(t), n > 1024) for i, t in rows)
    assert got == want


def test_token_cache_is_used_and_appended(spark, frame, corpus, tmp_path, monkeypatch):
    cache, path = str(tmp_path / "cache"), tokencount.default_tokenizer()
    first = rows_of(tokencount.count_tokens(frame(corpus[:80]), path, cache))
    kept = tokencount.read_cache(spark, cache)
    assert kept.count() == len({t for _, t in corpus[:80]}) and kept.select("version").distinct().count() == 1
    # only the new texts are encoded
    asked = []
    true = tokencount._encode
    monkeypatch.setattr(tokencount, "_encode", lambda rows, p: asked.append(rows.count()) or true(rows, p))
    both = rows_of(tokencount.count_tokens(frame(corpus), path, cache))
    assert asked == [len({t for _, t in corpus} - {t for _, t in corpus[:80]})] and not first - both
    assert rows_of(tokencount.count_tokens(frame(corpus), path, cache)) == both and len(asked) == 1
    # what is stored is believed, of this version only
    spark.createDataFrame([("other", kept.first()["content"], 10**6)], tokencount.SCHEMA).write.mode("append").parquet(cache)
    assert rows_of(tokencount.count_tokens(frame(corpus), path, cache)) == both


@pytest.mark.parametrize("most", [0, 1 << 40])
def test_token_counts_whatever_is_broadcast(spark, frame, corpus, library, tmp_path, monkeypatch, most):
    rows = corpus + [(k, corpus[0][1]) for k in range(1000, 1300)] + [(2000, "same row")] * 50
    monkeypatch.setattr(tokencount, "MOST_BROADCAST", most)
    got = rows_of(tokencount.count_tokens(frame(rows), tokencount.default_tokenizer(), str(tmp_path / "cache")).select("doc_id", "n_tokens"))
    assert got == Counter((i, library(t)) for i, t in rows)


def test_token_counts_of_other_tokenizers_and_empty_tables(spark, frame, tmp_path):
    import sentencepiece
    from tokenizers import Tokenizer

    texts = ["Hello  World <|endoftext|> x", "", "naïve café 日本語", "a" * 5000]
    docs, cache = frame(list(enumerate(texts))), str(tmp_path / "cache")
    word = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    piece = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for name, count in (("word_bpe_49k.json", lambda t: len(word.encode(t, add_special_tokens=False))), ("piece_bpe_32k.model", lambda t: len(piece.encode(t)))):
        got = tokencount.count_tokens(docs, public_tokenizers.path(name), cache)
        assert {r["doc_id"]: r["n_tokens"] for r in got.collect()} == {i: count(t) for i, t in enumerate(texts)}
    assert tokencount.count_tokens(docs.limit(0), tokencount.default_tokenizer(), cache).count() == 0
    assert tokencount.read_cache(spark, cache).select("version").distinct().count() == 2
    with pytest.raises(ValueError):
        tokencount.version_of("ranks.tiktoken")


def test_long_texts_are_cut_where_counts_add_up(library):
    rng = random.Random(3)
    text = "".join(rng.choice(["word", " next", "  ", "\n", "'s", "<|endoftext|>", " 12", "é", "!?", " "]) for _ in range(30_000))
    count = tokencount.counter(tokencount.default_tokenizer(), limit=500)
    assert len(tokencount.pieces(text, 500)) > 50 and "".join(tokencount.pieces(text, 500)) == text
    assert count([text, "x" * 50_000, ""]) == [library(text), library("x" * 50_000), 0]


def test_settled_code_points_split_as_the_library_splits():
    import regex
    from tokenizers import Tokenizer

    split = Tokenizer.from_file(tokencount.default_tokenizer()).pre_tokenizer.pre_tokenize_str
    pattern = regex.compile(public_tokenizers.PATTERN)
    for c in [c for c in range(0xD7A4) if tokencount.SETTLED.fullmatch(chr(c))]:
        text = f"a{chr(c)}1 {chr(c)}{chr(c)} ."
        assert [o for _, o in split(text)] == [m.span() for m in pattern.finditer(text)], hex(c)


# Vector codes


def brute_codes(rows, parts=8, entries=16, rounds=6):
    """Python integers only."""
    kept = [(i, [int(np.floor(4096 * float(x))) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    step = len(kept[0][1]) // parts
    cut = lambda v: [tuple(v[p * step : (p + 1) * step]) for p in range(parts)]
    xs = [cut(v) for _, v, _ in kept]
    first = sorted(range(len(kept)), key=lambda r: kept[r][0])[:entries]
    books = [[xs[r][p] for r in first] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda x, book: min((far(x, c), k) for k, c in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            members = {}
            for x in xs:
                members.setdefault(nearest(x[p], books[p])[1], []).append(x[p])
            for k, m in members.items():
                books[p][k] = tuple(sum(c) // len(m) for c in zip(*m))
    out, sums = [], Counter()
    for (i, _, label), x in zip(kept, xs):
        found = [nearest(x[p], books[p]) for p in range(parts)]
        out.append((i, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found), label))
        sums[label] += out[-1][2]
    import hashlib

    sha = hashlib.sha256(",".join(str(y) for b in books for e in b for y in e).encode()).hexdigest()
    return {(i, code, error, sums[label], sha) for i, code, error, label in out}


VECTORS = "vec_id long, embedding array<float>, label int, code string, n int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, label, "x", 1) for i, v, label in rows], VECTORS)


def test_vector_codes_equal_integers(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=32).astype(np.float32).tolist(), None if i % 5 == 0 else i % 3) for i in range(400)]
    rows += [(1000 + i, rows[7][1], 1) for i in range(200)]  # a hot vector
    rows += [(5000, None, 1), (5001, [None] * 32, 1), (5002, [float("nan")] * 32, 2), (5003, [float("inf")] + [0.0] * 31, 2)]
    assert {tuple(r) for r in vqcode.encode(vectors(spark, rows)).collect()} == brute_codes(rows)


def test_vector_codes_of_ties_few_rows_and_odd_lengths(spark):
    rows = [(i, [float(i % 3)] * 8, 0) for i in range(9)]
    assert {tuple(r) for r in vqcode.encode(vectors(spark, rows)).collect()} == brute_codes(rows)
    odd = rows + [(50, [1.0] * 5, 0), (51, [], 7)]
    got = {r["vec_id"]: r for r in vqcode.encode(vectors(spark, odd)).collect()}
    assert len(got) == 11 and got[50]["code"] is None and got[51]["label_error"] is None and got[3]["code"] is not None
    assert vqcode.encode(vectors(spark, rows).limit(0)).count() == 0
    assert vqcode.encode(vectors(spark, [(1, None, 1)])).count() == 0
    # repeated ids: one seed an id, rows count as they stand; a null id comes last
    again = vqcode.encode(vectors(spark, [*rows, *rows, (None, [9.0] * 8, 3)]))
    assert again.count() == 19


@pytest.mark.parametrize("scale", [1, 1000, 2**20, 2**27])
def test_screening_finds_the_nearest_entry_with_close_ties(scale):
    rng = np.random.default_rng(scale)
    for n in (1, 8, 32):
        entries = rng.integers(-scale, scale + 1, size=(16, n))
        entries[5] = entries[2]  # equal entries: the lower index
        entries[9] = entries[3]
        entries[9, 0] += 1
        # halfway between two entries, off by one at most
        x = np.concatenate([rng.integers(-scale, scale + 1, size=(300, n)), (entries[3] + entries[9])[None] // 2 + rng.integers(-1, 2, size=(100, n)), (entries[1] + entries[7])[None] // 2 + rng.integers(-1, 2, size=(100, n))])
        x = np.clip(x, -scale, scale)
        best, far, told = vqcode.screen(x, entries)
        exact = ((x[:, None, :] - entries[None]) ** 2).sum(axis=2)
        assert (best == exact.argmin(axis=1)).all() and (far == exact.min(axis=1)).all()
        assert told < exact.size or n == 1 or scale == 1


def test_huge_components_are_held(spark):
    rows = [(i, [1e30 if i % 2 else -1e30] + [0.5] * 7, 0) for i in range(20)]
    got = vqcode.encode(vectors(spark, rows)).collect()
    assert len(got) == 20 and {r["error"] for r in got} == {0}


# Spelling variants


def brute_words(rows):
    n = Counter()
    for i, t in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(LOW)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 5:
                n[run] += 1
    return {w: c for w, c in n.items() if c >= 3}


def is_near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute_variants(rows):
    n, out = brute_words(rows), {}
    near = {w: [v for v in n if v != w and is_near(w, v)] for w in n}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None)
    return out


def variants(df, **more):
    return {r["word"]: tuple(r)[1:] for r in spelling.group_variants(df, **more).collect()}


@pytest.fixture(scope="module")
def misspelt():
    """Texts of words and their variants: ends, doubled letters, long words, accents, chains of forms."""
    rng = random.Random(9)
    base = ["letter", "colour", "aaaaaa", "banana", "straße", "éclair", "abcde", "x" * 40, "abcdefghij" * 30, "interest", "interests", "interned"]
    letters, rows = "abcxyzéÿ×", []
    for i in range(150):
        words = []
        for _ in range(30):
            w = rng.choice(base)
            if rng.random() < 0.3:
                p, c, kind = rng.randrange(len(w) + 1), rng.choice(letters), rng.randrange(3)
                w = w[:p] + (c if kind else "") + w[p + (kind != 1) :]
            words.append(w.upper() if rng.random() < 0.1 else w)
        rows.append((i, " ".join(words)))
    return rows


@pytest.mark.parametrize("most", [64, 1])
def test_variants_equal_brute_force(spark, frame, misspelt, most):
    rows = misspelt + ODD
    assert variants(frame(rows), most=most) == brute_variants(rows)


def test_a_shared_half_of_very_many_words(spark, frame):
    rng = random.Random(2)
    tails = sorted({"".join(rng.choice("ab") for _ in range(6)) for _ in range(400)})
    rows = [(k, " ".join("common" + t for t in tails)) for k in range(4)]
    df = frame(rows)
    spans = spelling.places(spelling.words(df))
    assert spans.filter("role = 0 and b - a > 1").groupBy("key").count().agg(F.max("count")).first()[0] <= spelling.MOST_SHARED
    assert variants(df) == brute_variants(rows)


def test_edit_place_and_forms_in_chains(spark, frame):
    for a, b, place in (("abcde", "abcde", None), ("abcde", "abcdef", 5), ("aabb", "abb", 1), ("abb", "aabb", 1), ("abcd", "axcd", 1), ("abcd", "axyd", None), ("abcdef", "abcd", None)):
        assert spelling.edit_place(a, b) == place
    rows = [(0, "aaaaab " * 40 + "aaaacb " * 18 + "aaadcb " * 8 + "aagdcb " * 3)]
    got = variants(frame(rows))
    assert got == brute_variants(rows) and got["aagdcb"][:2] == ("aaadcb", "aaaaab")


def test_variants_of_nothing(spark, frame):
    assert variants(frame([(1, None), (2, ""), (None, "1 2 3")])) == {}
    assert variants(frame([(1, "x")]).limit(0)) == {}
