"""Personal data by base patterns and bootstrapped contextual extraction, with DataFrame functions only.

Base: e-mail addresses, IP addresses, card numbers and phone numbers by regular expressions. The expressions are written
so that Java's matcher neither recurses nor rescans a long run of characters, with the same leftmost matches.

Bootstrap: the seeds are the base spans. A pattern is the two words before an instance, or the word before and the word
after it (small letters, digits as 0). Patterns with SUPPORT distinct seed words of a kind, and SUPPORT_SHARE of all of that kind
(in a large corpus any common context holds a few by chance), are looked up in all texts; the words that stand in them, of any form, and the patterns are a graph, which Spark scores SCORINGS times. A pattern's score for a
kind is the sum of its words' scores over their number, where words of the kind and plain words (letters in one case, short
numbers) count whole and words of an odd form that are not known yet count UNKNOWN; only patterns with SUPPORT words of the kind
and a score of CONFIDENT count on; the many that hold too many plain words for that are told by an exact bound before all their words are gathered (`hopeful`). A word's score is one minus the product of (1 - score) over such patterns (seeds keep 1).
Words of ACCEPT or more (plain words: PLAIN) are taken if SHARE of all their occurrences stand in such patterns. Their other
contexts induce new patterns, and so on for ROUNDS rounds. In the end every occurrence of a taken word outside the base spans
is a span of its kind. Instances found this way are single words of MIN_LENGTH or more, without signs at their ends.

Defined results: a null text is empty: no spans, base_sha256 of the empty string, spans ''; texts of any length are read
whole; repeated rows give repeated results; a null doc_id is kept; extra columns are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

KINDS = ("email", "ip", "card", "phone")
ROUNDS, SCORINGS, SUPPORT, LIFT = 2, 3, 5, 5.0
CONFIDENT, UNKNOWN, ACCEPT, PLAIN, SHARE, MIN_LENGTH = 0.8, 0.25, 0.8, 0.95, 0.5, 5
#: Bits that mark wanted words.
BITS = 1 << 16
#: One row in so many shows which patterns hold too many plain words to be confident.
PART = 8
#: Matches of one text that are placed in one go.
PIECE = 256

WORD = r"[^\x20\x09-\x0D]"
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9]){15,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Words that are nothing odd; signs that are no part of an identifier at its ends.
PLAIN_WORD = r"^(?:\p{L}[\p{Ll}'’-]*|\p{Lu}{1,5})$"
COMMON = r"^(?:\p{L}[\p{Ll}'’-]*|\p{Lu}{1,5}|[0-9]{1,4})$"
SIGNS = ".,;:!?()[]{}<>\"'`*_-/|=&"


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with value worked out once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def located(text: Column, pattern: str) -> Column:
    """All matches as (start, end, hit): code points, end exclusive."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    paired = F.zip_with(F.slice(gaps, F.lit(1), F.size(hits)), hits, lambda gap, hit: F.struct(F.length(gap).alias("gap"), F.length(hit).alias("size"), hit.alias("hit")))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,hit:string>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        return F.struct((start + x["size"]).alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), (start + x["size"]).alias("end"), x["hit"].alias("hit")))).alias("out"))

    def place(p: Column) -> Column:
        # Growing an array copies it: places are summed within pieces of PIECE matches, then the pieces are moved along.
        pieces = F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.size(p) - 1) / PIECE).cast("int"), F.lit(0))), lambda c: F.aggregate(F.slice(p, c * PIECE + 1, F.lit(PIECE)), zero, step))
        return let(pieces, moved)

    def moved(pieces: Column) -> Column:
        none = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        begins = F.aggregate(pieces, none, lambda acc, x: F.struct((acc["at"] + x["at"]).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])
        return F.flatten(F.zip_with(pieces, begins, lambda piece, by: F.transform(piece["out"], lambda x: F.struct((x["start"] + by).alias("start"), (x["end"] + by).alias("end"), x["hit"].alias("hit")))))

    return let(paired, place)


def luhn(digits: Column) -> Column:
    def doubled(d: Column) -> Column:
        return F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)

    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 1, doubled(c.try_cast("int"))).otherwise(c.try_cast("int")))
    return F.aggregate(each, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def valid(kind: str, hit: Column) -> Column:
    digits = F.regexp_replace(hit, "[^0-9]", "")
    if kind == "ip":
        part = lambda p: F.regexp_replace(p, "^0+", "")
        return F.forall(F.split(hit, r"\."), lambda p: (F.length(part(p)) <= 3) & (F.coalesce(part(p).try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return F.length(digits).between(16, 19) & luhn(digits)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


def base_spans(docs: DataFrame, text: Column) -> DataFrame:
    """docs with an array of spans for each kind."""
    none = F.array().cast("array<struct<start:int,end:int,hit:string>>")
    may = {"email": text.contains("@"), "phone": text.contains("+"), "ip": F.lit(True), "card": F.lit(True)}
    out = docs.withColumns({kind: F.when(may[kind] & text.rlike(BASE[kind]), located(text, BASE[kind])).otherwise(none) for kind in KINDS})

    def holds(kind: str):
        return lambda x: valid(kind, x["hit"])

    return out.withColumns({kind: F.filter(kind, holds(kind)) for kind in KINDS})


def folded(text: Column) -> Column:
    return F.translate(F.lower(text), "123456789", "0" * 9)


def contexts(before2: Column, before: Column, after: Column) -> Column:
    """The patterns of a place: two words before, or one before and one after; none at a text's beginning."""
    empty = lambda c: F.coalesce(c, F.lit(""))
    keys = F.array(F.xxhash64(F.lit("before"), empty(before2), before), F.xxhash64(F.lit("between"), before, empty(after)))
    return F.when(empty(before) != "", keys).otherwise(F.array().cast("array<bigint>"))


def pairs(before2: Column, before: Column, after: Column) -> Column:
    """The two words of each pattern of a place, in the order of its contexts."""
    pair = lambda a, b: F.struct(F.coalesce(a, F.lit("")).alias("a"), F.coalesce(b, F.lit("")).alias("b"))
    return F.array(pair(before2, before), pair(before, after))


def words_in(text: Column) -> Column:
    """All words of a text (small letters, digits as 0)."""
    return F.array_remove(F.split(folded(text), r"[\x20\x09-\x0D]"), "")


def word_counts(slim: DataFrame, text: Column, wanted: DataFrame) -> DataFrame:
    """How often the wanted words (table of word, n of another meaning) stand in all texts; the empty one, beside every text, once for each. The wanted words' hashes
    mark BITS bits; words without a marked bit are not counted, so that the shuffle follows the wanted words and not the vocabulary. The driver holds the bits."""
    bit = F.pmod(F.xxhash64("word"), F.lit(BITS))
    marks = wanted.select(bit.alias("b")).groupBy(F.floor(F.col("b") / 64).cast("int").alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b % 64 as int))")).alias("bits"))
    held = dict(marks.collect())  # BITS / 64 rows at most
    mask = F.array(*[F.lit(held.get(i, 0)).cast("long") for i in range(BITS // 64)])
    each = slim.select(F.explode(F.concat(F.array(F.lit("")), words_in(text))).alias("word"))
    marked = F.getbit(F.get(mask, F.floor(bit / 64).cast("int")), (bit % 64).cast("int")) == 1
    return each.filter(marked).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def all_words(rows: DataFrame, text: Column) -> DataFrame:
    """Every word of every text: row, pos, word (without signs at its ends), keys and pairs (its patterns)."""
    blank = r"[\x20\x09-\x0D]"
    words = F.array_remove(F.split(text, blank), "")
    low = F.array_remove(F.split(folded(text), blank), "")
    edge = F.array(F.lit(""))
    beside = rows.select("row", words.alias("w"), low.alias("f"))
    zipped = F.arrays_zip(F.col("w").alias("w"), F.concat(edge, edge, F.col("f")).alias("p2"), F.concat(edge, F.col("f")).alias("p1"), F.slice("f", F.lit(2), F.size("f")).alias("n1"))
    # The outer form: the plain one would work the arrays out a second time, to look for empty ones.
    out = beside.select("row", F.posexplode_outer(zipped).alias("pos", "x")).filter(F.col("x.w").isNotNull())
    return out.select("row", "pos", F.btrim("x.w", F.lit(SIGNS)).alias("word"), contexts(F.col("x.p2"), F.col("x.p1"), F.col("x.n1")).alias("keys"), pairs(F.col("x.p2"), F.col("x.p1"), F.col("x.n1")).alias("pairs"))


def seeds_of(slim: DataFrame, text: Column) -> DataFrame:
    """One row per base span: row, pos of the word that it begins in, word (the span), kind, keys and pairs (its patterns)."""
    held = slim.filter(F.concat(*KINDS) != F.array().cast("array<struct<start:int,end:int,hit:string>>"))
    words = held.select("row", F.posexplode(located(text, rf"{WORD}++")).alias("pos", "x")).select("row", "pos", F.col("x.start").alias("at"), folded(F.col("x.hit")).alias("f"))
    words = cut(words, "pii_words")

    def named(kind: str) -> Column:
        return F.transform(kind, lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["hit"].alias("word")))

    spans = held.select("row", F.explode(F.concat(*map(named, KINDS))).alias("s")).select("row", "s.*")
    # The words that a span begins and ends in are the last ones begun at or before its start, and before its end.
    none = lambda t: F.lit(None).cast(t)
    event = lambda at, what: spans.select("row", F.col(at).alias("at"), F.lit(what).alias("what"), none("int").alias("pos"), "kind", "start", "word")
    events = words.select("row", "at", F.lit(1).alias("what"), "pos", none("string").alias("kind"), none("int").alias("start"), none("string").alias("word")).unionByName(event("start", 2)).unionByName(event("end", 0))
    so_far = Window.partitionBy("row").orderBy("at", "what").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = events.withColumn("near", F.last("pos", ignorenulls=True).over(so_far)).filter(F.col("kind").isNotNull())
    placed = near.groupBy("row", "kind", "start").agg(F.first("word").alias("word"), F.max(F.when(F.col("what") == 2, F.col("near"))).alias("pos"), F.max(F.when(F.col("what") == 0, F.col("near"))).alias("last"))
    order = Window.partitionBy("row").orderBy("pos")
    around = words.select("row", "pos", F.lag("f", 2).over(order).alias("p2"), F.lag("f", 1).over(order).alias("p1"), F.lead("f", 1).over(order).alias("n1"))
    found = placed.join(around.select("row", "pos", "p2", "p1"), ["row", "pos"]).join(around.select("row", F.col("pos").alias("last"), "n1"), ["row", "last"])
    return found.select("row", "pos", "word", "kind", contexts(F.col("p2"), F.col("p1"), F.col("n1")).alias("keys"), pairs(F.col("p2"), F.col("p1"), F.col("n1")).alias("pairs"))


def supported(instances: DataFrame, slim: DataFrame, text: Column) -> DataFrame:
    """Patterns with enough distinct words of a kind, and more than by chance: key, kind. instances: word, kind, keys, pairs."""
    distinct = instances.select(F.explode(F.arrays_zip("keys", "pairs")).alias("x"), "kind", "word").filter("x.keys IS NOT NULL").select(F.col("x.keys").alias("key"), "x.pairs", "kind", "word").distinct()
    counted = cut(distinct.groupBy("key", "kind").agg(F.count("*").alias("n"), F.first("pairs").alias("pair")).filter(F.col("n") >= SUPPORT), "pii_supported")
    all_of = instances.select("kind", "word").distinct().groupBy("kind").agg(F.count("*").alias("all"))  # a row for each kind
    counts = cut(word_counts(slim, text, counted.select(F.explode(F.array("pair.a", "pair.b")).alias("word")).distinct()), "pii_counts")
    total = F.lit(float(slim.agg(F.sum("n_words") + F.count(F.lit(1))).first()[0] or 1))
    share = lambda c: counts.select(F.col("word").alias(c), F.col("n").alias(f"n_{c}"))
    known = counted.select("key", "kind", "n", "pair.a", "pair.b").join(share("a"), "a").join(share("b"), "b").join(F.broadcast(all_of), "kind")
    chance = F.col("all") * (F.col("n_a") / total) * (F.col("n_b") / total)
    return known.filter(F.col("n") >= LIFT * chance).select("key", "kind")


def standing(places: DataFrame, keys: DataFrame, seeds: DataFrame | None) -> DataFrame:
    """Distinct edges (key, word, common) of places (row, pos, word, keys) in the patterns `keys`. seeds: None for places where no base span begins."""
    stands = places.select("row", "pos", "word", F.explode("keys").alias("key")).join(keys, "key")
    # A base span stands as itself, whatever word it begins in.
    if seeds is not None:
        stands = stands.join(seeds.select("row", "pos", F.col("word").alias("span")), ["row", "pos"], "left").select("key", F.coalesce("span", "word").alias("word"))
    return stands.select("key", "word").filter(F.col("word") != "").distinct().withColumn("common", F.col("word").rlike(COMMON))


def hopeful(shown: DataFrame, touched: DataFrame | None) -> DataFrame:
    """Patterns (key) that may be strong. shown: edges with all words of an odd form and some of the common ones; touched: all edges of common words that
    have a score (None: no common word has one). A pattern's score is at most the share that words with a score could have among the words that count
    whole: its odd words and its touched ones beside its other common words, of which there are those shown or more."""
    rows = shown.select("key", "word", "common", F.lit(False).alias("known"))
    if touched is not None:
        rows = rows.unionByName(touched.select("key", "word", F.lit(True).alias("common"), F.lit(True).alias("known")))
        rows = rows.groupBy("key", "word").agg(F.max("common").alias("common"), F.max("known").alias("known"))
    plain = F.col("common") & ~F.col("known")
    counts = rows.groupBy("key").agg(F.count_if(plain).alias("plain"), F.count_if(~plain).alias("others"))
    return counts.filter((F.col("others") >= SUPPORT) & (F.col("others") >= (CONFIDENT - 1e-9) * (F.col("others") + F.col("plain")))).select("key")


class Graph:
    """The edges of all patterns that may be strong, and what is known of the others."""

    def __init__(self, slim: DataFrame, text: Column, seeds: DataFrame) -> None:
        self.slim, self.text, self.seeds = slim, text, seeds
        self.shown: DataFrame | None = None
        self.edges: DataFrame | None = None
        self.whole: DataFrame | None = None

    def scored(self, new: DataFrame, name: str) -> tuple[DataFrame, DataFrame] | None:
        """Strong patterns and scores of words (see `scored`) with the patterns `new` beside the earlier ones; None if no pattern may be strong."""
        in_part = F.pmod("row", F.lit(PART)) == 0
        # A base span begins in a word with a digit, an @ or a +: none in a plain one.
        seen = standing(all_words(self.slim, self.text).filter(in_part | ~F.col("word").rlike(PLAIN_WORD)), new, self.seeds)
        self.shown = cut(seen if self.shown is None else self.shown.unionByName(seen), f"{name}_shown")
        touched, out, tries = None, None, 0
        while True:
            fit = hopeful(self.shown, touched)
            fit = cut(fit if self.whole is None else fit.join(self.whole, "key", "left_anti"), f"{name}_fit_{tries}")
            if not fit.isEmpty():
                rest = standing(all_words(self.slim, self.text).filter(~in_part & F.col("word").rlike(PLAIN_WORD)), fit, None)
                more = self.shown.join(fit, "key", "left_semi").unionByName(rest).distinct()
                self.edges = cut(more if self.edges is None else self.edges.unionByName(more), f"{name}_edges_{tries}")
                self.whole = fit if self.whole is None else self.whole.unionByName(fit)
            elif out is not None or self.whole is None:
                return out
            strong, scores, met = scored(self.edges, self.seeds, f"{name}_{tries}")
            out = strong, scores
            # Common words with a score may lift patterns that were out of the question.
            met = cut(met.filter(F.col("word").rlike(COMMON)).select("word").distinct(), f"{name}_met_{tries}")
            others = self.shown.select("key").distinct().join(self.whole, "key", "left_anti")
            if met.isEmpty():
                return out
            touched = cut(all_words(self.slim, self.text).join(met, "word").select("word", F.explode("keys").alias("key")).join(others, "key").select("key", "word").distinct(), f"{name}_touched_{tries}")
            tries += 1


def scored(edges: DataFrame, seeds: DataFrame, name: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Strong patterns (key, kind, p) and scores of words (word, kind, score) of a graph of distinct edges (key, word, common); words that had a score in any scoring."""
    size = edges.groupBy("key").agg(F.sum(F.when(F.col("common"), 1.0).otherwise(UNKNOWN)).alias("weight"))
    scores = seeds.select("word", "kind").distinct().withColumn("score", F.lit(1.0))
    known, met = scores, scores.select("word")
    for k in range(SCORINGS):
        own = F.when(F.col("common"), 0.0).otherwise(1.0 - UNKNOWN)  # a word of the kind counts whole
        total = edges.join(scores, "word").groupBy("key", "kind").agg(F.sum("score").alias("total"), F.sum(own).alias("more"), F.count("*").alias("known")).filter(F.col("known") >= SUPPORT)
        strong = total.join(size, "key").withColumn("p", F.col("total") / (F.col("weight") + F.col("more"))).filter(F.col("p") >= CONFIDENT).select("key", "kind", "p")
        found = edges.join(strong, "key").groupBy("word", "kind").agg((F.lit(1.0) - F.exp(F.sum(F.log1p(-F.least(F.col("p"), F.lit(0.999)))))).alias("score"))
        strong = cut(strong, f"{name}_patterns_{k}")
        if strong.isEmpty():
            break
        scores = cut(known.unionByName(found).groupBy("word", "kind").agg(F.max("score").alias("score")), f"{name}_scores_{k}")
        met = met.unionByName(scores.select("word"))
    return strong, scores, met


def bootstrap(slim: DataFrame, text: Column) -> DataFrame | None:
    """Occurrences of taken words: row, pos, word, kind; None if there are none."""
    seeds = cut(seeds_of(slim, text), "pii_seeds")
    graph, keys, taken = Graph(slim, text, seeds), None, None
    instances = seeds.select("word", "kind", "keys", "pairs")
    for k in range(ROUNDS):
        new = supported(instances, slim, text).select("key").distinct()
        new = cut(new if keys is None else new.join(keys, "key", "left_anti"), f"pii_keys_{k}")
        if new.isEmpty():
            break
        keys = new if keys is None else keys.unionByName(new)
        found = graph.scored(new, f"pii_{k}")
        if found is None:
            break
        strong, scores = found
        candidates = scores.join(seeds.select("word").distinct(), "word", "left_anti").filter((F.length("word") >= MIN_LENGTH) & (F.col("score") >= F.when(F.col("word").rlike(COMMON), PLAIN).otherwise(ACCEPT)))
        candidates = cut(candidates.groupBy("word").agg(F.max_by("kind", F.struct("score", "kind")).alias("kind")), f"pii_candidates_{k}")
        if candidates.isEmpty():
            break
        places = cut(all_words(slim, text).join(candidates, "word").select("row", "pos", "word", "kind", "keys", "pairs"), f"pii_places_{k}")
        strongly = places.select("row", "pos", "word", "kind", F.explode("keys").alias("key")).join(strong.select("key", "kind"), ["key", "kind"], "left_semi").select("row", "pos", "word").distinct().groupBy("word").agg(F.count("*").alias("n"))
        kept = places.groupBy("word").agg(F.count("*").alias("all")).join(strongly, "word").filter(F.col("n") >= SHARE * F.col("all")).select("word")
        taken = cut(places.join(kept, "word"), f"pii_taken_{k}")
        instances = seeds.select("word", "kind", "keys", "pairs").unionByName(taken.select("word", "kind", "keys", "pairs"))
    return None if taken is None else taken.select("row", "pos", "word", "kind")


def listed(spans: Column) -> Column:
    """kind:start:end of spans (place of the kind, start, end), comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", F.element_at(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def keyed(kind: int, spans: Column) -> Column:
    return F.transform(spans, lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end")))


def find_spans(docs: DataFrame, whole: bool = False) -> DataFrame:
    """doc_id (with whole: `kept`, a struct of all columns), `base` and `spans`, arrays of (kind from 1, start, end)."""
    rows = docs.select(F.struct(*docs.columns).alias("kept")) if whole else docs.select("doc_id", "text")
    text = F.coalesce(F.col("kept.text") if whole else F.col("text"), F.lit(""))
    slim = cut(base_spans(rows, text).withColumns({"row": F.monotonically_increasing_id(), "n_words": F.size(words_in(text))}), "pii_found")  # row ids are fixed from here on
    base = F.concat(*[keyed(i + 1, F.col(k)) for i, k in enumerate(KINDS)])
    out = slim.withColumn("base", base).drop(*KINDS, "n_words")
    taken = bootstrap(slim, text)
    if taken is None:
        return out.withColumn("spans", F.array_sort("base")).drop("row", *([] if whole else ["text"]))
    by_row = taken.groupBy("row").agg(F.collect_list(F.struct("pos", "word", "kind")).alias("taken"))
    names = F.array(*[F.lit(k) for k in KINDS])

    def span(words: Column):
        def one(x: Column) -> Column:
            hit = F.get(words, x["pos"])
            start = hit["start"] + F.length(hit["hit"]) - F.length(F.ltrim(hit["hit"], F.lit(SIGNS)))
            return F.struct(F.array_position(names, x["kind"]).cast("int").alias("kind"), start.alias("start"), (start + F.length(x["word"])).alias("end"))

        return one

    free = lambda x: ~F.exists("base", lambda b: (b["start"] < x["end"]) & (b["end"] > x["start"]))
    placed = let(located(text, rf"{WORD}++"), lambda words: F.filter(F.transform("taken", span(words)), free))
    none = F.array().cast("array<struct<kind:int,start:int,end:int>>")
    out = out.join(by_row, "row", "left").withColumn("more", F.when(F.col("taken").isNotNull(), placed).otherwise(none))
    return out.withColumn("spans", F.array_sort(F.concat("base", "more"))).drop("row", "taken", "more", *([] if whole else ["text"]))


def pii(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, counts of base spans by kind, base_sha256, spans."""
    found = find_spans(docs)

    def count(place: int) -> Column:
        return F.size(F.filter("base", lambda x: x["kind"] == place)).cast("long").alias(f"n_{KINDS[place - 1]}")

    counts = [count(i + 1) for i in range(len(KINDS))]
    return found.select("doc_id", *counts, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def redacted(text: Column, spans: Column) -> Column:
    """text with every span replaced by its kind in angle brackets; of overlapping spans the first stays whole."""
    names = F.array(*[F.lit(f"<{k}>") for k in KINDS])
    ordered = F.array_sort(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), (-x["end"]).alias("back"), x["kind"].alias("kind"))))
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("done"))

    def step(acc: Column, x: Column) -> Column:
        end = -x["back"]
        grown = F.concat(acc["done"], F.substring(text, acc["at"] + 1, x["start"] - acc["at"]), F.element_at(names, x["kind"]))
        skip = x["start"] < acc["at"]
        return F.struct(F.when(skip, F.greatest(acc["at"], end)).otherwise(end).alias("at"), F.when(skip, acc["done"]).otherwise(grown).alias("done"))

    return F.aggregate(ordered, zero, step, lambda acc: F.concat(acc["done"], F.substring(text, acc["at"] + 1, F.length(text))))
