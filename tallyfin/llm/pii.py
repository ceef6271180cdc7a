"""Personal data by bootstrapped contextual extraction, in DataFrame operations only.

Seeds are the matches of four fixed patterns (e-mail, IP, card, phone) and long hexadecimal keys.  What
stands around a mention on its line is its lexical patterns: the word before it (with the word before
that if it is a mere sign), alone, with the word before that, with the word after it, and with the mention's shape.  Mentions, seeds and other
identifier-like tokens alike, form a bipartite graph of patterns and instances that is scored by turns:
a pattern's precision for a kind is the share of its mentions that its instances' confidences make up,
and an instance's confidence is the noisy-or of its patterns' precisions.  Patterns of high precision
with enough different seeds label unseen identifiers.

Positions come from splitting a text by the same expression that extracts its matches: a match starts
after all parts and matches before it, and its context is in the parts beside it.  Running lengths are
taken in runs of RUN matches and then over the runs, and seeds are blanked out before unseen identifiers
are sought, so no step compares a mention with another or counts from the text's start: time is linear in
the text but for the few numbers of its runs.  The expressions are written with possessive quantifiers
and start only where a run starts or the last match ended, which finds the same leftmost matches in linear
time.  Texts are read once; only mentions (not words) are shuffled, and counts aggregate partially.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfin.llm.common import checkpoint

#: The kinds in order, each with an expression equal to the specified one, and what every text with a match has.
KINDS = {
    "email": (r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    "ip": (r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "[0-9][.][0-9]"),
    "card": (r"[0-9](?:[ -]?+[0-9])++", "[0-9](?:[ -]?[0-9]){15}"),
    "phone": (r"\+[0-9][ ().0-9-]+[0-9]", "[+][0-9]"),
}
#: What the method adds may also be of this kind: a hexadecimal key of 32 digits or more is a seed of it, no match of the base.
SECRET, KEY = "secret", r"^(?=[^a-f]*+[a-f])(?=[^0-9]*+[0-9])[0-9a-f]{32,}+$"
#: What may be an identifier: a number in brackets and what follows, three or more short groups of digits, or a token with a digit or an @.
IDENTIFIER = (
    r"(?<!\S)(?:\([0-9]{1,5}\) ?[0-9][0-9.-]*+(?: [0-9][0-9.-]*+){0,4}+(?![^\s.,;:!?])|[0-9]{2,4}(?: [0-9]{2,5}){2,5}+(?![^\s.,;:!?])|[^\s0-9@]*+[0-9@]\S*+)"
)
IP_PARTS = r"^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])){3}$"
#: Turns of scoring, least precision of a pattern and confidence of an instance, and least number of different seeds.
TURNS, PRECISION, SEEDS = 2, 0.8, 3
#: An unseen identifier has so many characters, and so many digits or an @ between two characters on either side.
LEAST_CHARS, MOST_CHARS, LEAST_DIGITS = 6, 128, 4
#: Matches whose lengths are added up at once, characters of a part that may be context, and what blanks a seed out.
RUN, BESIDE, BLANK = 256, 64, "\x01"


def _located(df: DataFrame, text: dict[str, str], expressions: dict[str, tuple[str, str | None]], keep: list[str]) -> DataFrame:
    """keep, and by name all matches of its expression in its text column, in order: array of (start, end, value, before, after); code points, end exclusive.

    Each step is a projection of its own, so that no array is made anew for each element of another.
    Also name_parts: the parts between the matches (null without any match).
    """
    names = list(expressions)
    has = {n: F.col(text[n]).rlike(t) if t else F.lit(True) for n, (_, t) in expressions.items()}
    held = [*keep, *sorted(set(text.values()) - set(keep))]
    df = df.select(*held, *(F.when(has[n], F.regexp_extract_all(F.col(text[n]), F.lit(e), F.lit(0))).alias(f"{n}_found") for n, (e, _) in expressions.items()))
    some = {n: F.size(f"{n}_found") > 0 for n in names}
    df = df.select(*keep, *(f"{n}_found" for n in names), *(F.when(some[n], F.split(F.col(text[n]), expressions[n][0], -1)).alias(f"{n}_parts") for n in names))

    def measured(n: str) -> Column:
        found, parts = F.col(f"{n}_found"), F.col(f"{n}_parts")
        beside = F.arrays_zip(F.slice(parts, 1, F.size(found)).alias("part"), found.alias("value"), F.slice(parts, 2, F.size(found)).alias("next"))
        return F.when(some[n], F.transform(beside, lambda z: F.struct(
            F.length(z["part"]).cast("long").alias("gap"), F.length(z["value"]).cast("long").alias("n"), z["value"].alias("value"),
            F.lower(F.substring(z["part"], -BESIDE, BESIDE)).alias("before"), F.lower(F.substring(z["next"], 1, BESIDE)).alias("after"),
        ))).alias(f"{n}_each")

    parts = [f"{n}_parts" for n in names]
    df = df.select(*keep, *parts, *map(measured, names))

    def runs(n: str) -> Column:
        each = F.col(f"{n}_each")
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(each) - 1) / RUN).cast("int")), lambda b: F.slice(each, b * RUN + 1, F.lit(RUN))).alias(f"{n}_runs")

    df = df.select(*keep, *parts, *map(runs, names))
    span = "array<struct<start: bigint, end: bigint, value: string, before: string, after: string>>"

    def step(state: Column, x: Column) -> Column:
        begin = state["at"] + x["gap"]
        one = F.struct(begin.alias("start"), (begin + x["n"]).alias("end"), x["value"].alias("value"), x["before"].alias("before"), x["after"].alias("after"))
        return F.struct((begin + x["n"]).alias("at"), F.concat(state["spans"], F.array(one)).alias("spans"))

    begin = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(span).alias("spans"))
    df = df.select(*keep, *parts, *(F.transform(f"{n}_runs", lambda run: F.aggregate(run, begin, step)).alias(f"{n}_runs") for n in names))
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("offsets"))

    def offsets(n: str) -> Column:
        add = lambda s, x: F.struct((s["at"] + x["at"]).alias("at"), F.concat(s["offsets"], F.array(s["at"])).alias("offsets"))
        return F.aggregate(f"{n}_runs", zero, add, lambda s: s["offsets"]).alias(f"{n}_offsets")

    df = df.select(*keep, *parts, *(f"{n}_runs" for n in names), *map(offsets, names))

    def spans(n: str) -> Column:
        moved = F.transform(F.arrays_zip(F.col(f"{n}_runs").alias("run"), F.col(f"{n}_offsets").alias("offset")), lambda z: F.transform(z["run"]["spans"], lambda s: F.struct(
            (s["start"] + z["offset"]).alias("start"), (s["end"] + z["offset"]).alias("end"), s["value"].alias("value"), s["before"].alias("before"), s["after"].alias("after"),
        )))
        return F.coalesce(F.flatten(moved), F.array().cast(span)).alias(n)

    return df.select(*keep, *parts, *map(spans, names))


def _valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return value.rlike(IP_PARTS)
    if kind == "card":
        return F.length(digits).between(16, 19) & F.call_function("luhn_check", F.when(F.length(digits) <= 19, digits).otherwise("1"))
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


def _blanked(df: DataFrame, kind: str, text: str, keep: list[str]) -> DataFrame:
    """keep, and the text with the valid matches of a kind replaced by blanks of the same length.  Rows have kind_parts and the kind's matches."""
    each = F.arrays_zip(F.slice(f"{kind}_parts", 1, F.size(kind)).alias("part"), F.col(f"{kind}.value").alias("value"))
    told = F.transform(each, lambda z: F.concat(z["part"], F.when(_valid(kind, z["value"]), F.repeat(F.lit(BLANK), F.length(z["value"]))).otherwise(z["value"])))
    whole = F.concat(F.array_join(told, ""), F.element_at(f"{kind}_parts", -1))
    return df.select(*keep, F.when(F.size(kind) > 0, whole).otherwise(F.col(text)).alias(text))


def _contexts(before: Column, after: Column, value: Column) -> Column:
    """Patterns around a mention, within its line: the word before it, alone, after the word before that, with the word after it, and with the mention's shape."""
    one = F.regexp_extract(before, r"(\S++)[ \t]++[\"'(\[<]*+$", 1)
    two = F.regexp_extract(before, r"(?<!\S)(\S++[ \t]++\S++)[ \t]++[\"'(\[<]*+$", 1)
    then = F.regexp_extract(after, r"^[\"')\]>.,;:!?]*+[ \t]++(\S++)", 1)
    shape = F.regexp_replace(F.regexp_replace(value, "[a-z]++", "a"), "[0-9]++", "9")
    word = F.when(one.rlike(r"[\p{L}0-9]"), one).when(two.rlike(r"[\p{L}0-9]"), two)  # a sign alone says nothing
    pair = F.when(word.isNotNull() & (two != ""), two)
    both = F.when(then != "", F.concat(word, F.lit(" _ "), then))
    return F.array_distinct(F.array_compact(F.array(word, pair, both, F.concat(word, F.lit(" # "), shape))))


def _mentions(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Per row: doc_id, hash of the text, base spans, and mentions (kind or null, start, end, instance, contexts)."""
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    found = _located(docs, dict.fromkeys(KINDS, "text"), KINDS, ["doc_id", "text"])

    def named(kind: str) -> Column:
        held = F.filter(kind, lambda s: _valid(kind, s["value"]))
        return F.transform(held, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), s["before"].alias("before"), s["after"].alias("after")))

    base = F.concat(*map(named, KINDS)).alias("base")
    rest = _blanked(found.select("doc_id", "text", base, F.col("text").alias("rest"), "phone", "phone_parts"), "phone", "rest", ["doc_id", "text", "base"])
    # valid cards and phones never overlap, and a token that holds any blank is left out, so e-mails and IPs may be sought in what is left
    for kind in ("card", "ip", "email"):
        rest = rest.select("*", F.when(F.array_contains("base.kind", kind), F.col("rest")).alias("part"))
        rest = _located(rest, {kind: "part"}, {kind: KINDS[kind]}, ["doc_id", "text", "base", "rest"])
        rest = _blanked(rest, kind, "rest", ["doc_id", "text", "base"])
    free = _located(rest, {"tokens": "rest"}, {"tokens": (IDENTIFIER, "[0-9@]")}, ["doc_id", "text", "base"])

    def trimmed(s: Column) -> Column:
        area = s["value"].rlike(r"^\([0-9]+\)")
        left = F.when(area, 0).otherwise(F.length(F.regexp_extract(s["value"], r"^[^A-Za-z0-9]*+", 0)))
        right = F.length(F.regexp_extract(s["value"], r"(?<=[A-Za-z0-9])[^A-Za-z0-9]++$", 0))
        core = F.substring(s["value"], left + 1, F.length(s["value"]) - left - right)
        return F.struct(
            (s["start"] + left).alias("start"), (s["end"] - right).alias("end"), F.lower(core).alias("value"),
            F.concat(s["before"], F.lower(F.substring(s["value"], F.lit(1), left))).alias("before"), F.concat(F.lower(F.substring(s["value"], F.length(s["value"]) - right + 1, right)), s["after"]).alias("after"),
        )

    digits = lambda v: F.length(F.regexp_replace(v, "[^0-9]", ""))
    short = F.filter("tokens", lambda s: (F.length(s["value"]) <= MOST_CHARS) & ~s["value"].contains(BLANK))
    free = free.select("doc_id", "text", "base", F.transform(short, trimmed).alias("tokens"))
    taken = F.filter("tokens", lambda s: (F.length(s["value"]) >= LEAST_CHARS) & ((digits(s["value"]) >= LEAST_DIGITS) | s["value"].rlike("[^@]{2}@[^@]{2}")))

    def mention(s: Column, kind: Column, value: Column) -> Column:
        return F.struct(kind.alias("kind"), s["start"].alias("start"), s["end"].alias("end"), value.alias("instance"), _contexts(s["before"], s["after"], value).alias("contexts"))

    seeds = F.transform("base", lambda s: mention(s, s["kind"], F.lower(s["value"])))
    unseen = F.transform(taken, lambda s: mention(s, F.when(s["value"].rlike(KEY), F.lit(SECRET)), s["value"]))
    return free.select("doc_id", F.xxhash64("text").alias("text_hash"), F.transform("base", lambda s: F.struct(s["kind"], s["start"], s["end"])).alias("base"), F.concat(seeds, unseen).alias("mentions"))


#: Mentions that are no matches of the base.
BEYOND = f"kind is null or kind = '{SECRET}'"


def _discover(mentions: DataFrame) -> DataFrame:
    """(instance, kind) of identifiers beyond the base in patterns of high precision.  mentions: (kind, instance, context)."""
    weight = mentions.groupBy("context", "instance", "kind").agg(F.count("*").alias("n"))
    weight = checkpoint(weight)
    total = weight.groupBy("context").agg(F.sum("n").alias("all"))
    seeds = weight.filter("kind is not null").groupBy("context", "kind").agg(F.count("*").alias("seeds"), F.sum("n").cast("double").alias("mass"))
    learned, accepted = None, None
    for _ in range(TURNS):
        mass = seeds if learned is None else (
            seeds.select("context", "kind", "seeds", "mass").unionAll(learned).groupBy("context", "kind").agg(F.sum("seeds").alias("seeds"), F.sum("mass").alias("mass"))
        )
        patterns = mass.join(total, "context").select("context", "kind", "seeds", (F.col("mass") / F.col("all")).alias("precision"))
        patterns = patterns.filter((F.col("seeds") >= SEEDS) & (F.col("precision") >= (PRECISION if accepted is not None else PRECISION / 2)))
        reached = weight.filter(BEYOND).select("context", "instance", "n").join(patterns, "context")
        confidence = 1 - F.exp(F.sum(F.ln(F.greatest(F.lit(1e-9), 1 - F.col("precision")))))
        accepted = reached.groupBy("instance", "kind").agg(confidence.alias("confidence"))
        learned = reached.join(accepted, ["instance", "kind"]).groupBy("context", "kind").agg(F.lit(0).cast("bigint").alias("seeds"), F.sum(F.col("n") * F.col("confidence")).alias("mass"))
    sure = accepted.filter(F.col("confidence") >= PRECISION)
    return sure.groupBy("instance").agg(F.max_by("kind", F.struct("confidence", "kind")).alias("kind"))


def find_personal_data(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans and n_added (all spans, and those that contexts
    added, of these kinds or "secret"), and found (the latter as an array of kind, start, end).

    Null text counts as empty: no spans, the hash of an empty string.  Repeated rows are all kept; a
    null doc_id stays null and is searched like any other row.
    """
    made = checkpoint(_mentions(df, id_col, text_col))
    flat = made.select("doc_id", "text_hash", F.explode("mentions").alias("m")).select("doc_id", "text_hash", "m.*")
    unseen = _discover(flat.select("kind", "instance", F.explode("contexts").alias("context")))
    added = (
        flat.filter(BEYOND).drop("kind", "contexts").join(unseen, "instance")
        .groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("kind", "start", "end")).alias("found"))
    )
    out = made.alias("r").join(added.alias("a"), F.col("r.doc_id").eqNullSafe(F.col("a.doc_id")) & (F.col("r.text_hash") == F.col("a.text_hash")), "left")
    of = lambda spans, kind: F.filter(spans, lambda s: s["kind"] == kind)
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    found = F.coalesce("a.found", F.array().cast("array<struct<kind: string, start: bigint, end: bigint>>"))
    row = out.select(F.col("r.doc_id").alias("doc_id"), F.col("r.base").alias("base"), found.alias("found"))
    all_spans = F.concat(*(F.array_sort(F.concat(of("base", k), of("found", k)), lambda x, y: F.when(x["start"] < y["start"], -1).when(x["start"] > y["start"], 1).otherwise(0)) for k in (*KINDS, SECRET)))
    return row.select(
        "doc_id", *(F.size(of("base", k)).cast("long").alias(f"n_{k}") for k in KINDS),
        F.sha2(said(F.col("base")), 256).alias("base_sha256"), said(all_spans).alias("spans"),
        (F.size("base") + F.size("found")).cast("long").alias("n_spans"), F.size("found").cast("long").alias("n_added"), "found",
    )
