"""Benchmark decontamination by template windows, with DataFrame functions only.

Texts become streams of lower-case words in which numbers, units after numbers
and names inside a sentence stand as typed placeholders, so a benchmark question
that was given other numbers or names keeps its template.  A capitalised word
where a sentence may start counts as a word and as a name.  Windows of ``WINDOW``
template tokens are hashed and joined with the windows of the benchmark.  Where
matched windows hold placeholders, the values behind them are compared along the
alignment: one benchmark value must always stand for the same document value.

Templates are made only of documents that can matter.  A document must hold
``MIN_SHARE`` of an item's windows, hence an anchor (the first two plain words that
stand side by side) of each of these windows.  The scan that reads a text looks its
word pairs up among the anchors and leaves out documents that have too few of them
for every item; of the others, the anchors that were met are joined with their items,
and documents stay that have enough of one item.  That is exact and one plan at every
size.  Windows without such a pair are taken as given; where they are half of an item,
each of their words or values is enough to let a document through.

The anchors' hashes are literals of that filter, ``MOST_LITERALS`` at most (of more
anchors, classes of hashes are).  The benchmark's windows are broadcast only while
they are fewer than ``BROADCAST_WINDOWS`` (they are counted first); beyond it the
join shuffles the windows of the documents let through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotweave.llm.text import LETTERS, broadcast_below, checkpoint, in_few, unused

WINDOW = 8
MIN_SHARE = 0.5
BROADCAST_WINDOWS = 1_000_000
#: Tables of document keys are counted, and broadcast up to so many rows.
BROADCAST_KEYS = 1_000_000
#: Bytes of a row of keys; of an item's readings and of its windows for each byte of its text.
ROW, READING, WINDOWED = 40, 16, 64
MOST_LITERALS = 1 << 16

#: Units that count as such after a number.
UNITS = (
    "km", "m", "cm", "mm", "mi", "ft", "kg", "g", "mg", "lb", "oz", "l", "ml", "h", "hr", "hrs", "hours", "min", "minutes", "s", "sec",
    "seconds", "days", "weeks", "months", "years", "usd", "eur", "dollars", "euros", "cents", "percent", "kb", "mb", "gb", "tb", "hz", "khz", "w", "kw", "v",
)

# a placeholder is START, its kind, the value it stands for, and END
START, END = "", ""
_UPPER, _LOWER = r"[A-ZÀ-ÞΑ-ΩА-Я]", r"[a-zß-ÿα-ωа-я]"
_UNITS = "|".join(UNITS)
#: a number ends before a unit attached to it, but before no other letter
_NUMBER = rf"(?=[0-9+-])(?<![{LETTERS}])[+-]?[0-9]+(?:[.,:/][0-9]+)*(?=(?i:{_UNITS})?(?![{LETTERS}]))"
_UNIT = rf"({START}[np][^{END}]*{END})\s?({_UNITS})(?![{LETTERS}])"
_ALONE = rf"{_UPPER}(?<![,;:a-zß-ÿ]\s{_UPPER})(?<![{LETTERS}]{_UPPER}){_LOWER}+"
_FIRST = rf"{_ALONE}(?![{LETTERS}])"
_FIRST_RUN = rf"{_ALONE}(?:(?<=[a-zß-ÿ])\s{_UPPER}{_LOWER}+)+(?![{LETTERS}])"
_NAME = rf"{_UPPER}(?<=[,;:a-zß-ÿ{END}]\s{_UPPER}){_LOWER}+(?:\s{_UPPER}{_LOWER}+)*(?![{LETTERS}])(?![{LETTERS}\s]*{END})"
_TOKEN = rf"{START}[^{END}]*{END}|[{LETTERS}]+"


def tokens_of(text: Column, runs: bool = False) -> Column:
    """Template tokens of a text, placeholders with their values.

    A capitalised word where a sentence may start is of the kind ``s``, a word or
    a name.  With ``runs``, one with more capitalised words behind it is one name
    with them, of the kind ``r``.
    """
    t = F.translate(F.coalesce(text, F.lit("")), START + END, "")
    if runs:
        t = F.regexp_replace(t, _FIRST_RUN, f"{START}r$0{END}")
    t = F.regexp_replace(t, _FIRST, f"{START}s$0{END}")
    t = F.regexp_replace(t, _NAME, f"{START}p$0{END}")
    t = F.regexp_replace(t, _NUMBER, f"{START}n$0{END}")
    t = F.regexp_replace(F.lower(t), _UNIT, f"$1 {START}u$2{END}")
    return F.regexp_extract_all(t, F.lit(_TOKEN), F.lit(0))


def readings_of(text: Column) -> Column:
    """Both token arrays of a text, or one where they are the same."""
    return F.array_distinct(F.array(tokens_of(text), tokens_of(text, runs=True)))


def _marked(token: Column) -> Column:
    return F.startswith(token, F.lit(START))


def _kind(token: Column) -> Column:
    """Kind of a placeholder, empty for a word."""
    return F.when(_marked(token), F.substring(token, 2, 1)).otherwise(F.lit(""))


def _value(token: Column) -> Column:
    """The text that a token stands for."""
    return F.when(_marked(token), F.regexp_replace(token, f"^{START}.|{END}$", "")).otherwise(token)


def _loose(token: Column) -> Column:
    """Whether a token may be a word or a name."""
    return F.startswith(token, F.lit(START + "s"))


def _is_name(kind: Column) -> Column:
    return kind.isin("p", "r", "s")


def _templates(tokens: Column) -> Column:
    """Every template of one window: a word that may be a name stands for both."""

    def one(token: Column) -> Column:
        return F.when(_loose(token), _value(token)).when(_is_name(_kind(token)), F.lit(START + "p")).when(_marked(token), F.substring(token, 1, 2)).otherwise(token)

    def longer(known: Column, token: Column) -> Column:
        named = F.when(_loose(token), F.transform(known, lambda k: F.array_append(k, F.lit(START + "p")))).otherwise(F.array().cast("array<array<string>>"))
        return F.concat(F.transform(known, lambda k: F.array_append(k, one(token))), named)

    every = F.aggregate(tokens, F.array(F.array().cast("array<string>")), longer)
    return F.when(F.exists(tokens, _loose), every).otherwise(F.array(F.transform(tokens, one)))


def _place(tokens: str, at: Column) -> Column:
    """A position in the reading without runs, in which a run is two tokens."""
    return at + F.size(F.filter(F.slice(tokens, 1, at), lambda t: F.startswith(t, F.lit(START + "r"))))


def _words_mostly(template: Column) -> Column:
    return F.size(F.filter(template, lambda t: ~_marked(t))) * 2 > WINDOW


def _hashes(tokens: Column) -> Column:
    """Hashes of one window: of its templates, or of its values where placeholders are half of a template or more."""
    values = F.xxhash64(F.lit(START), F.transform(tokens, _value))
    return F.array_distinct(F.transform(_templates(tokens), lambda t: F.when(_words_mostly(t), F.xxhash64(t)).otherwise(values)))


def _prepared(token: Column) -> Column:
    """What windows need of a token: itself, its template as a word and as a name, its value, and its class (1: placeholder, 16: word or name)."""
    sure = F.when(_is_name(_kind(token)), F.lit(START + "p")).otherwise(F.substring(token, 1, 2))
    value = _value(token)
    loose = F.struct(token.alias("token"), value.alias("word"), F.lit(START + "p").alias("name"), value.alias("value"), F.lit(16).alias("kind"))
    marked = F.struct(token.alias("token"), sure.alias("word"), sure.alias("name"), value.alias("value"), F.lit(1).alias("kind"))
    plain = F.struct(token.alias("token"), token.alias("word"), token.alias("name"), token.alias("value"), F.lit(0).alias("kind"))
    return F.when(~_marked(token), plain).when(_loose(token), loose).otherwise(marked)


def _windows(rows: DataFrame, tokens: str, *keep: str) -> DataFrame:
    """(keep..., at, window): one row for each hash of each window of the token column.

    Windows with several words that may be names go the general way; the others have
    one template or two.  The explodes are outer ones: for inner ones Spark would
    infer filters on the arrays' sizes and copy the whole computation into them.
    """
    each = rows.withColumn("_prepared", F.explode_outer(F.array(F.transform(tokens, _prepared))))
    parts = ("word", "name", "value", "kind")
    each = each.select("*", *(F.col(f"_prepared.{p}").alias(f"_{p}") for p in parts))
    each = each.withColumn("_arrays", F.explode_outer(F.array(F.struct(*(f"_{p}" for p in parts))))).select(*{*keep, tokens}, *(F.col(f"_arrays._{p}") for p in parts))

    def of_window(i: Column) -> Column:
        kinds = F.get("_kind", i)
        for k in range(1, WINDOW):
            kinds = kinds + F.get("_kind", i + k)
        cut = lambda column: F.slice(column, i + 1, WINDOW)
        values = F.xxhash64(F.lit(START), cut("_value"))
        mostly = lambda column, more: F.when((kinds % 16 + more) * 2 < WINDOW, F.xxhash64(cut(column))).otherwise(values)
        return F.when(kinds < 16, F.array(mostly("_word", 0))).when(kinds < 32, F.array_distinct(F.array(mostly("_word", 0), mostly("_name", 1)))).otherwise(_hashes(cut(tokens)))

    last = F.size(tokens) - WINDOW
    hashed = each.withColumn("_hashes", F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), of_window)).otherwise(F.array().cast("array<array<long>>")))
    return hashed.select(*keep, F.posexplode_outer("_hashes").alias("at", "_each")).filter("at IS NOT NULL").select(*keep, "at", F.explode_outer("_each").alias("window"))


def benchmark_items(benchmark: DataFrame) -> DataFrame:
    """(item_id, tokens): an item once for each of its readings."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("item_id IS NOT NULL")
    return items.select("item_id", F.explode_outer(readings_of(F.col("text"))).alias("tokens")).distinct()


def benchmark_windows(items: DataFrame) -> DataFrame:
    """(item_id, version, item_at, place, window, weight, anchors): every window, with anchors of which a document that holds it has one.

    That is the first pair of neighbouring words that can't be names.  Windows without
    one weigh nothing and have their longest such word or else the first term of each
    value, for a number also with the unit behind it attached.
    """
    plain = lambda t: F.coalesce(~_marked(t), F.lit(False))
    pairs = F.transform("_tokens", lambda t, i: F.when(plain(t) & plain(F.get("_tokens", i + 1)), F.concat_ws(" ", t, F.get("_tokens", i + 1))))
    longest = lambda texts: F.array_max(F.transform(F.array_compact(texts), lambda t: F.struct(F.length(t).alias("n"), t.alias("t"))))["t"]
    own = F.filter("_tokens", lambda t: ~_marked(t))
    first = lambda t: F.regexp_extract(_value(t), f"[{LETTERS}]+", 0)
    values = F.flatten(F.transform("_tokens", lambda t, i: F.array(first(t), F.concat(first(t), F.coalesce(_value(F.get("_tokens", i + 1)), F.lit(""))))))
    return (
        _windows(items, "tokens", "item_id", "version", "tokens").withColumn("_tokens", F.slice("tokens", F.col("at") + 1, WINDOW))
        .withColumns({"pair": F.get(F.array_compact(pairs), 0), "word": longest(own)})
        .withColumn("place", _place("tokens", F.col("at")))
        .withColumn("weight", F.when(F.col("pair").isNotNull(), 1).otherwise(0))
        .withColumn("anchors", F.when(F.col("weight") == 1, F.array("pair")).when(F.col("word").isNotNull(), F.array("word")).otherwise(values))
        .select("item_id", "version", F.col("at").alias("item_at"), "place", "window", "weight", "anchors").distinct()
    )


#: Items are let through the scan by classes of how many anchors they need, each by its least one.
NEEDS = (1, 2, 3, 4, 6, 8, 12, 16, 24, 32)


def candidates(docs: DataFrame, windows: DataFrame, sizes: DataFrame) -> DataFrame:
    """(doc_id, text_key, text), once each: documents that may hold MIN_SHARE of an item's windows, by the anchors in their texts."""
    given = windows.groupBy("item_id").agg(F.countDistinct(F.when(F.col("weight") == 0, F.col("place"))).alias("given"))
    needed = given.join(sizes, "item_id").select("item_id", (MIN_SHARE * F.col("item_windows") - F.col("given")).alias("needed"))
    each = windows.select("item_id", "place", "weight", F.explode("anchors").alias("anchor")).join(needed, "item_id").filter("weight = 1 OR needed <= 0")
    hash_of = F.when(F.col("weight") == 1, F.xxhash64(F.split("anchor", " ")[0], F.split("anchor", " ")[1])).otherwise(F.xxhash64("anchor"))
    anchors = each.withColumn("hash", hash_of).groupBy("item_id", "needed", "hash", "weight").agg(F.countDistinct("place").alias("n"))
    # the fewest anchors whose windows make up what an item needs
    fewest = F.aggregate(
        F.sort_array("counts", asc=False), F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("k")),
        lambda a, n: F.struct((a["sum"] + n).alias("sum"), (a["k"] + F.when(a["sum"] < F.col("needed"), 1).otherwise(0)).alias("k")),
    )["k"]
    needs = anchors.groupBy("item_id", "needed").agg(F.collect_list(F.when(F.col("weight") == 1, F.col("n"))).alias("counts")).select("item_id", F.greatest(fewest, F.lit(1)).alias("k"))
    anchors = checkpoint(in_few(anchors.join(needs, "item_id").select("item_id", "needed", "hash", "weight", (F.col("n") * F.col("weight")).alias("n"), "k"), 4 * windows.count() * ROW))
    wide = anchors.select("hash").distinct().count() > MOST_LITERALS
    if wide:  # classes of hashes stand for hashes: more documents get through, none is lost
        anchors = anchors.withColumn("hash", F.pmod("hash", F.lit(MOST_LITERALS)))
    reduced = lambda h: F.pmod(h, F.lit(MOST_LITERALS)) if wide else h
    literals = lambda rows: [r["hash"] for r in rows.select("hash").distinct().collect()]
    met_in = lambda hashes, known: F.filter(F.transform(hashes, reduced), lambda h: h.isin(known))
    terms = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(f"[{LETTERS}]+"), F.lit(0))
    # the outer explodes keep filters from being pushed into the computation of what they filter
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text", F.explode_outer(F.array(terms)).alias("w"))
    pairs, single = literals(anchors.filter("weight = 1")), literals(anchors.filter("weight = 0"))
    met = met_in(F.transform("w", lambda w, i: F.xxhash64(w, F.get("w", i + 1))), pairs)
    if single:
        met = F.concat(met, met_in(F.transform("w", lambda w: F.xxhash64(w)), single))
    read = read.withColumn("met", F.explode_outer(F.array(F.array_distinct(met))))
    enough = F.lit(False)
    for low, high in zip(NEEDS, [*NEEDS[1:], 1 << 30], strict=True):
        known = literals(anchors.filter((F.col("k") >= low) & (F.col("k") < high)))
        if known:
            enough = enough | (F.size(F.filter("met", lambda h: h.isin(known))) >= low)  # noqa: B023
    some = checkpoint(read.filter(F.size("met") > 0).withColumn("_enough", F.explode_outer(F.array(enough))).filter("_enough").select("doc_id", "text_key", "text", "met"))
    by_anchor = some.select("doc_id", "text_key", F.explode("met").alias("hash")).join(broadcast_below(anchors, BROADCAST_WINDOWS), "hash")
    held = by_anchor.groupBy("doc_id", "text_key", "item_id", "needed").agg(F.collect_set(F.struct("hash", "n")).alias("held"))
    wanted = held.filter(F.aggregate("held", F.lit(0).cast("long"), lambda n, x: n + x["n"]) >= F.col("needed")).select(F.col("doc_id").alias("d"), F.col("text_key").alias("k")).distinct()
    both = some.join(wanted, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("k")), "left_semi")
    size = some.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return in_few(both.groupBy("doc_id", "text_key").agg(F.first("text").alias("text")), size)  # rows may repeat


def alignments(read: DataFrame, windows: DataFrame) -> DataFrame:
    """(doc_id, text_key, doc_version, item_id, version, shift): where a window of an item is found in a document."""
    known = broadcast_below(windows.select("item_id", "version", "item_at", "window").distinct(), BROADCAST_WINDOWS)
    found = _windows(read, "doc_tokens", "doc_id", "text_key", "doc_version").join(known, "window")
    return found.select("doc_id", "text_key", "doc_version", "item_id", "version", (F.col("at") - F.col("item_at")).alias("shift")).distinct()


def _compared(tokens: str, doc_tokens: str) -> Column:
    """An item's tokens beside those of a document along an alignment."""

    def one(token: Column, at: Column) -> Column:
        other = F.get(doc_tokens, at + F.col("shift").cast("int"))
        kind, doc_kind = _kind(token), _kind(other)
        same = F.coalesce(_value(token) == _value(other), F.lit(False))
        word = F.coalesce(same & kind.isin("", "s") & doc_kind.isin("", "s"), F.lit(False))
        slot = F.coalesce(~word & _marked(token) & ((kind == doc_kind) | (_is_name(kind) & _is_name(doc_kind))), F.lit(False))
        sure = word | (slot & ((kind != "s") | (at == 0)) & (doc_kind != "s"))
        return F.struct(_value(token).alias("item"), _value(other).alias("doc"), word.alias("word"), slot.alias("slot"), sure.alias("sure"), same.alias("same"))

    return F.transform(tokens, one)


def _held(compared: str) -> tuple[Column, Column]:
    """Starts of the windows that an alignment holds, in three sets: all, those of words mostly, those of equal values.

    Windows that are placeholders mostly say nothing alone: they count beside one
    of words mostly, or with equal values.  The second set takes words at sentence
    starts as words, so it holds where such a word was exchanged without a system.
    """

    def one(at: Column) -> Column:
        part = F.slice(compared, at + 1, WINDOW)
        mostly = F.size(F.filter(part, lambda x: x["word"])) * 2 > WINDOW
        return F.struct(at.alias("at"), F.forall(part, lambda x: x["word"] | x["slot"]).alias("fits"), F.forall(part, lambda x: x["sure"]).alias("sure"), mostly.alias("mostly"), F.forall(part, lambda x: x["same"]).alias("same"))

    each = F.transform(F.sequence(F.lit(0), F.size(compared) - WINDOW), one)
    starts = lambda wanted: F.transform(F.filter("each", wanted), lambda w: w["at"])
    clear = starts(lambda w: w["fits"] & w["mostly"])
    return each, F.array(F.when(F.size(clear) > 0, starts(lambda w: w["fits"])).otherwise(clear), starts(lambda w: w["sure"] & w["mostly"]), starts(lambda w: w["same"]))


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents that hold a benchmark item: doc_id, text_key, item_id, n_windows, item_windows, n_slots.

    One row for each document and item of which at least MIN_SHARE of the item's
    windows occur in the document with consistent slots; ``n_slots`` counts the
    placeholders compared.  Windows of which half or more are placeholders count
    along an alignment that has a window of words mostly, or where their values
    are equal.  Items of fewer than WINDOW template tokens never match; null or
    empty texts and an empty benchmark match nothing.  Rows with a null doc_id
    are reported with a null doc_id; repeated rows give one row.  ``text_key`` is
    ``xxhash64(text)``.  Other columns are ignored.
    """
    size = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    items = checkpoint(in_few(benchmark_items(benchmark).withColumn("version", F.xxhash64("tokens")), size * READING))
    sizes = items.groupBy("item_id").agg(F.greatest(F.max(F.size("tokens")) - WINDOW + 1, F.lit(0)).alias("item_windows"))
    windows = checkpoint(in_few(benchmark_windows(items), size * WINDOWED))
    read = checkpoint(candidates(docs, windows, sizes).select("doc_id", "text_key", F.posexplode_outer(readings_of(F.col("text"))).alias("doc_version", "doc_tokens")))
    hits = checkpoint(in_few(alignments(read, windows), 64 * read.count() * ROW))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("doc_id", "text_key", "doc_version")]
    both = hits.alias("a").join(read.alias("b"), same[0] & same[1] & same[2]).select("a.*", "doc_tokens").join(items, ["item_id", "version"])
    each, sets = _held("compared")
    # the outer explodes keep filters on computed arrays from being pushed into their computation
    compared = both.select("doc_id", "text_key", "item_id", "tokens", F.explode_outer(F.array(_compared("tokens", "doc_tokens"))).alias("compared"))
    held = compared.withColumn("each", F.explode_outer(F.array(each))).withColumn("windows", F.explode_outer(sets))
    spots = F.array_distinct(F.flatten(F.transform("windows", lambda w: F.sequence(w, w + WINDOW - 1))))
    pairs = F.transform(F.filter(F.transform(spots, lambda p: F.get("compared", p)), lambda x: x["slot"]), lambda x: F.struct(x["item"].alias("item"), x["doc"].alias("doc")))
    judged = held.withColumn("pairs", F.explode_outer(F.array(F.array_distinct(pairs))))
    # one benchmark value always stands for the same document value
    kept = judged.filter(F.size("pairs") == F.size(F.array_distinct(F.transform("pairs", lambda x: x["item"]))))
    kept = kept.withColumn("windows", F.transform("windows", lambda w: _place("tokens", w)))
    found = kept.groupBy("doc_id", "text_key", "item_id").agg(F.size(F.array_distinct(F.flatten(F.collect_set("windows")))).alias("n_windows"), F.max(F.size("pairs")).alias("n_slots"))
    return in_few(
        found.join(sizes, "item_id").filter((F.col("n_windows") > 0) & (F.col("n_windows") >= MIN_SHARE * F.col("item_windows")))
        .select("doc_id", "text_key", "item_id", F.col("n_windows").cast("long").alias("n_windows"), F.col("item_windows").cast("long").alias("item_windows"), F.col("n_slots").cast("long").alias("n_slots")),
        hits.count() * ROW,
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, with all their columns."""
    d, k = unused(docs, "d"), unused(docs, "k")
    found = contaminated(docs, benchmark).select(F.col("doc_id").alias(d), F.col("text_key").alias(k))
    found = broadcast_below(checkpoint(found).distinct(), BROADCAST_KEYS)
    return docs.join(found, F.col("doc_id").cast("long").eqNullSafe(F.col(d)) & (F.xxhash64("text") == F.col(k)), "left_anti")
