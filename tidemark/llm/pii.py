"""Personal data by bootstrapped contextual extraction (operator 10).

Seeds are the entities that four base patterns find. Every seed induces patterns: its kind with the word to its left,
or to its right. What else stands in such a slot is a candidate, whatever its form: a token with a digit or an at sign,
or a run of up to RUN such tokens. So a bipartite graph of patterns and instances arises, in which shapes (letters and
digits as runs) are patterns too. Scores go back and forth over it for a few rounds: a pattern is worth the mean score
of its distinct instances, an instance the mean of its well-supported patterns, and seeds keep the score 1. Instances
above the bar that at least two high-confidence context patterns extract are new identifiers, and their places are
added to the base spans; those of less than SHORT characters only where they stand in a slot.

Only expressions of the engine run. Regular expressions are possessive where that cannot change a match, so that
long runs cost linear time and no stack.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.common import text_of
from tidemark.staging import discard, staged

KINDS = ["email", "ip", "card", "phone"]
# The four base patterns. Where a run of the first class cannot match from its start it cannot match
# from within, so a match may only begin at the run's start or where the match before ended.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9]++(?:[\x20-][0-9]++)*+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
TOKEN = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"

SPAN = "array<struct<start:int,stop:int,match:string,left:string,right:string>>"
#: characters of context in which the neighbouring word is looked for
CONTEXT = 48
#: tokens of the longest run that is a candidate
RUN = 4
#: identifiers of fewer characters count only in a slot
SHORT = 6


def bound(value: Column, body) -> Column:
    """body(value) with the value computed once, however often a function over elements reads it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def spans(text: Column, pattern: str, guard: Column) -> Column:
    """Leftmost non-overlapping matches with their code-point places and the neighbouring words.

    Places are running sums over the pieces between matches. They are built in blocks of about the square root of the
    number of matches, so a text with very many of them does not copy a growing array once per match.
    """
    def add(acc, m):
        first = acc["at"] + F.length(m["before"])
        stop = first + F.length(m["match"])
        left = F.lower(F.regexp_extract(F.substring(m["before"], -CONTEXT, CONTEXT), r"(\S+)\s*$", 1))
        right = F.lower(F.regexp_extract(F.substring(m["after"], 1, CONTEXT), r"^\s*(\S+)", 1))
        return F.struct(stop.alias("at"), F.concat(acc["out"], F.array(F.struct(first.alias("start"), stop.alias("stop"), m["match"].alias("match"), left.alias("left"), right.alias("right")))).alias("out"))

    def placed(matches):
        n = F.size(matches)
        width = F.ceil(F.sqrt(n)).cast("int")

        def block(acc, b):
            done = F.coalesce(F.element_at(F.try_element_at(acc, F.lit(-1)), -1)["stop"], F.lit(0))
            rows = F.slice(matches, b * width + 1, width)
            return F.concat(acc, F.array(F.aggregate(rows, F.struct(done.alias("at"), F.array().cast(SPAN).alias("out")), add, lambda x: x["out"])))

        made = F.aggregate(F.sequence(F.lit(0), F.ceil(n / width).cast("int") - 1), F.array().cast(f"array<{SPAN}>"), block, F.flatten)
        return F.when(n > 0, made).otherwise(F.array().cast(SPAN))

    def zipped(pieces):
        found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        n = F.size(pieces) - 1
        return bound(F.arrays_zip(F.slice(pieces, 1, n).alias("before"), found.alias("match"), F.slice(pieces, 2, n).alias("after")), placed)

    return F.when(guard, bound(F.split(text, pattern, -1), zipped)).otherwise(F.array().cast(SPAN))


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)
    total = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda acc, i: acc + F.when((n - i) % 2 == 0, F.substring(digits, i, 1).cast("int")).otherwise(
        F.substring(digits, i, 1).cast("int") * 2 - F.when(F.substring(digits, i, 1).cast("int") > 4, F.lit(9)).otherwise(F.lit(0))))
    return total % 10 == 0


def _address(match: Column) -> Column:
    return F.forall(F.split(match, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.substring(F.concat(F.lit("0"), F.ltrim(p, F.lit("0"))), 1, 4).cast("int") <= 255))


def base_spans(text: Column) -> dict[str, Column]:
    digit = text.rlike("[0-9]")
    keep = {
        "email": (EMAIL, F.contains(text, F.lit("@")), None),
        "ip": (IP, digit, lambda s: _address(s["match"])),
        "card": (CARD, text.rlike(r"[0-9](?:[\x20-]?[0-9]){15}"), lambda s: F.when(F.length(_digits(s["match"])).between(16, 19), _luhn(_digits(s["match"]))).otherwise(F.lit(False))),
        "phone": (PHONE, F.contains(text, F.lit("+")), lambda s: F.length(_digits(s["match"])).between(8, 15)),
    }
    out = {}
    for kind, (pattern, guard, test) in keep.items():
        found = spans(text, pattern, guard)
        out[kind] = F.filter(found, test) if test else found
    return out


def _shape(match: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(match, "[A-Za-z]+", "a"), "[0-9]{4,}", "9999"), r"[0-9]{1,3}(?![0-9])", "9")


def _tagged(kind: str) -> Column:
    return F.transform(kind, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["stop"].alias("stop"), s["match"].alias("match"), s["left"].alias("left"), s["right"].alias("right")))


def _runs(tokens: Column) -> Column:
    """Every token, and every longest run of 2 to RUN tokens with one character between neighbours."""
    def found(v):
        def joins(i):
            return F.coalesce(F.get(v, i - 1)["stop"] + 1 == F.get(v, i)["start"], F.lit(False))

        def of(k):
            def here(i):
                return ~joins(i) & ~joins(i + k) & reduce(Column.__and__, [joins(i + j) for j in range(1, k)])

            def run(i):
                first, last = F.get(v, i), F.get(v, i + k - 1)
                return F.struct(first["start"].alias("start"), last["stop"].alias("stop"), F.concat_ws(" ", *[F.get(v, i + j)["match"] for j in range(k)]).alias("match"), first["left"].alias("left"), last["right"].alias("right"))

            return F.transform(F.filter(F.sequence(F.lit(0), F.size(v) - 1), here), run)

        return F.when(F.size(v) > 1, F.concat(v, *[of(k) for k in range(2, RUN + 1)])).otherwise(v)

    return bound(tokens, found)


def _scores(edges: DataFrame, rounds: int, support: int) -> DataFrame:
    """(instance, score, patterns) of instances that are no seeds, after the given rounds."""
    scored = staged(edges.groupBy("instance").agg(F.max("seed").cast("double").alias("score")), "instances")
    for _ in range(rounds):
        # both sums are formed before the shuffle, so a word next to a third of all tokens is no hot key
        worth = edges.join(scored, "instance").groupBy("pattern").agg(F.avg("score").alias("worth"), F.sum("score").alias("mass")).where(F.col("mass") >= support)
        heard = edges.join(worth, "pattern").groupBy("instance").agg(F.max("seed").alias("seed"), F.avg("worth").alias("mean"), F.count(F.when((F.col("worth") >= 0.9) & (F.col("pattern.side") != "shape"), 1)).alias("patterns"))
        after = staged(heard.select("instance", F.when(F.col("seed") == 1, F.lit(1.0)).otherwise(F.col("mean")).alias("score"), "seed", "patterns"), "instances")
        discard(scored)
        scored = after
    return scored.where("seed = 0").select("instance", "score", "patterns")


def personal_data(docs: DataFrame, rounds: int = 3, support: int = 5, bar: float = 0.9) -> DataFrame:
    """Per row: doc_id, n_email, n_ip, n_card, n_phone, base_sha256 and spans.

    `base_sha256` digests the base spans as kind:start:end (code points, end exclusive), kinds in the listed order,
    then by start; `spans` lists base spans and discovered ones in the same form. Null texts are empty. Rows with
    null or repeated ids are told apart by their text, and equal rows get equal results; an empty table gives none.
    """
    text = text_of()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("mark"), text.alias("text"))
    found = base_spans(F.col("text"))
    tokens = spans(F.col("text"), TOKEN, F.col("text").rlike("[0-9@]"))
    scanned = staged(rows.select("doc_id", "mark", *[c.alias(k) for k, c in found.items()], tokens.alias("token")), "scanned")
    kinds = F.concat(*[_tagged(k) for k in KINDS])
    base = scanned.select("doc_id", "mark", F.explode(kinds).alias("s")).select("doc_id", "mark", "s.*")
    # tokens that touch no base span, without the punctuation around them
    free = bound(kinds, lambda known: F.filter("token", lambda t: ~F.exists(known, lambda s: (s["start"] < t["stop"]) & (t["start"] < s["stop"]))))
    others = scanned.select("doc_id", "mark", F.explode(_runs(free)).alias("s")).select("doc_id", "mark", "s.*")
    lead = F.length(F.regexp_extract("match", r"^(?:(?!\([0-9]+\))[^0-9A-Za-z@+])*", 0))
    core = F.regexp_extract("match", r"(?:\([0-9]+\)|[0-9A-Za-z@+])(?:.*[0-9A-Za-z])?", 0)
    others = others.select("doc_id", "mark", (F.col("start") + lead).alias("start"), core.alias("match"), "left", "right").withColumn("stop", F.col("start") + F.length("match")).where("match <> ''")
    others = staged(others, "others")
    seeds = base.select("kind", "match", "left", "right", F.lit(1).alias("seed"))
    sides = F.array(F.struct(F.lit("left").alias("side"), F.col("left").alias("word")), F.struct(F.lit("right").alias("side"), F.col("right").alias("word")))
    by_seed = seeds.select("kind", "match", "seed", F.explode(sides).alias("s")).where("s.word <> ''").select("kind", "match", "seed", "s.*").distinct()
    by_seed = staged(by_seed, "by_seed")
    # a slot with fewer seeds than the support can have no weight at first
    slots = staged(by_seed.groupBy("kind", "side", "word").count().where(F.col("count") >= support).select("kind", "side", "word"), "slots")
    standing = others.select("doc_id", "mark", "start", "stop", "match", F.explode(sides).alias("s")).select("doc_id", "mark", "start", "stop", "match", "s.*").join(slots, ["side", "word"])
    standing = staged(standing, "standing")
    placed = by_seed.unionByName(standing.select("kind", "match", F.lit(0).alias("seed"), "side", "word"))
    # the shape speaks for an instance, but extracts none
    shaped = placed.select("kind", "match", "seed", F.lit("shape").alias("side"), _shape(F.col("match")).alias("word"))
    edges = placed.unionByName(shaped).groupBy(F.struct("kind", "side", "word").alias("pattern"), F.struct("kind", "match").alias("instance")).agg(F.max("seed").alias("seed"))
    edges = staged(edges, "edges")
    new = _scores(edges, rounds, support).where((F.col("score") >= bar) & (F.col("patterns") >= 2)).select("instance.kind", "instance.match")
    slotted = standing.select("doc_id", "mark", "kind", "match", "start", "stop").join(new, ["kind", "match"])
    anywhere = others.where(F.length("match") >= SHORT).select("doc_id", "mark", "match", "start", "stop").join(new, "match").select(slotted.columns)
    added = slotted.unionByName(anywhere).groupBy("doc_id", "mark").agg(F.collect_set(F.struct("kind", "start", "stop")).alias("new"))
    added = added.select(F.col("doc_id").alias("n_id"), F.col("mark").alias("n_mark"), "new")
    joined = scanned.join(added, F.col("doc_id").eqNullSafe(F.col("n_id")) & (F.col("mark") == F.col("n_mark")), "left")
    own = F.transform(kinds, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["stop"].alias("stop")))
    extra = F.coalesce("new", F.array().cast("array<struct<kind:string,start:int,stop:int>>"))
    order = F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))])

    def shown(array: Column) -> Column:
        keyed = F.array_sort(F.transform(array, lambda s: F.struct(F.element_at(order, s["kind"]).alias("k"), s["start"].alias("start"), s["stop"].alias("stop"), s["kind"].alias("kind"))))
        return F.array_join(F.transform(keyed, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")

    return joined.select("doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS], F.sha2(shown(own), 256).alias("base_sha256"), shown(F.array_union(own, extra)).alias("spans"))
