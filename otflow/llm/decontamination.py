"""Benchmark decontamination by template canonicalisation, in DataFrame functions only.

Numbers, names and units are replaced by typed placeholders, so that a question
asked anew with other values has the template of the benchmark's. Windows of
template tokens are joined by hash (and compared in full); where a window holds placeholders, the values behind them must correspond: along one alignment, equal
values of the item always stand for equal values of the document. A document is
contaminated by an item if ``coverage`` of the item's windows are found in it.

White space counts as one space, case and punctuation don't matter; numbers may
be written in words (``NUMBER_WORDS``). A capitalised
word is a name if it follows a lower-case letter, digit, comma or semicolon and a
space; one that starts a sentence of the benchmark is a name too if the same item
has it as one, or if it is neither in ``STARTERS`` nor a lower-case word of the
benchmark. A unit is one of ``UNITS`` after a digit. A text with names of several
words is read twice: word by word, and with each such name as one.

A document's windows are read with its names as placeholders, with all capitalised
words as placeholders, and with all names as lower-case words; an item's windows
likewise, where ordinary words that start its sentences stand for themselves only.
So copies in other case keep their names, and asked anew in proper case they may
have others. A copy that is both lower-cased and has other names is found by its
windows without names only. A window whose values are all the same is found
whatever stands elsewhere.

Windows with fewer than ``LITERALS`` words that aren't placeholders take no part.

Templates are made of those documents only that can be contaminated. Each window of
an item has a word that is no placeholder in any reading, the longest one
(:func:`keywords`); a document that holds ``coverage`` of the windows holds their
words. Documents with the words of fewer windows, of each item, are clean.

Documents are cut into stretches of ``STRETCH`` tokens that overlap by a window,
so that no row grows with a text's windows. The benchmark's windows are broadcast
up to ``BROADCAST_BYTES`` of them. Beyond, hashes and places alone are exchanged, and
a stretch's tokens are fetched only for windows that some item has.

Nulls and oddities: null and empty texts hold nothing and are clean; items with
fewer tokens than a window are one window as a whole (if it takes part); an empty benchmark leaves all clean;
items without id or with the same id count as one item each id. Rows sharing
doc_id are told apart by a hash of their texts; repeated rows get one result
each. An empty table gives an empty result; extra columns are kept by
:func:`remove_contaminated` and ignored by :func:`judge`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise

# Units as written after a number, short and long; long ones also with prefixes and in the plural.
_SHORT = "km|cm|mm|m|kg|mg|g|lb|lbs|oz|l|ml|cl|s|ms|min|h|hr|hrs|kw|kwh|w|v|a|j|n|hz|khz|mhz|ghz|gb|mb|kb|tb|mph|kph|kmh|rpm|ft|yd|pt|gal|kcal"
_PREFIXES = "kilo|centi|milli|mega|giga|micro|nano|deci"
_PREFIXED = "met(?:er|re)|lit(?:er|re)|gram(?:me)?|watt|volt|hertz|byte|bit|joule|newton|pascal|amp(?:ere)?|second|calorie|ton(?:ne)?"
_LONG = "hour|minute|day|week|month|year|decade|mile|yard|inch(?:e)?|acre|hectare|gallon|pint|quart|cup|barrel|pound|ounce|stone|dollar|euro|cent|penn(?:y|ie)|degree|percent|knot|radian"
UNITS = f"(?:(?:{_PREFIXES})?(?:{_PREFIXED})|{_LONG})s?|feet|foot|pence|{_SHORT}"
NUMBER_WORDS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion dozen half".split()
NAME, UNIT, NUMBER = "\u0001", "\u0002", "\u0003"
#: Marks of capitalised words that start a sentence: ordinary ones, and those of an item that are names.
START, FREE = "\u0004", "\u0005"
#: Joins the words of a name that is read as one.
JOIN = "\u0006"
_MARKS = NAME + UNIT + NUMBER + START + FREE + JOIN
_WORD = r"[\p{L}\p{M}]+"
_TOKEN = f"(?:{NAME}{_WORD}{JOIN})*[{NAME}{UNIT}{START}]?{_WORD}|[0-9]+(?:[.,][0-9]+)*|%"
# by first letter: fewer branches are tried at a word
_FEW = "(?:" + "|".join(f"{a}(?:" + "|".join(w[1:] for w in sorted(NUMBER_WORDS, key=len, reverse=True) if w[0] == a) + ")" for a in sorted({w[0] for w in NUMBER_WORDS})) + ")"
#: Ordinary words at the start of a sentence, whether or not the benchmark has them in lower case.
STARTERS = "a an the this that these those it its he she they we you i his her their our your my there here if when where while which who whom whose what why how is are was were do does did can could will would should may might must has have had in on at by for from of to with without after before during between under over about as and or but not no yes so then than because since although each every all some any both many much most more few one two three first second last next let find given suppose consider calculate compute determine choose select name write explain describe show prove solve use".split()
LITERALS = 2
STRETCH, BROADCAST_BYTES = 2_000, 64 << 20


def marked(text: Column) -> Column:
    """Lower-case text with single spaces and a mark before each name, other capitalised word and unit."""
    held = F.coalesce(text, F.lit(""))
    odd = F.rlike(held, F.lit(f"[{_MARKS}]"))
    plain = F.when(odd, F.translate(held, _MARKS, " " * len(_MARKS))).otherwise(held)
    plain = F.regexp_replace(plain, r"[\s\p{Z}&&[^\x20]][\s\p{Z}]*|\x20[\s\p{Z}]+", " ")
    units = F.regexp_replace(plain, rf"(?i)(?<=[0-9])(\x20?)({UNITS})(?![\p{{L}}\p{{N}}])", f"$1{UNIT}$2")
    held = F.when(F.rlike(plain, F.lit("[0-9]")), units).otherwise(plain)
    # the capital is tried before what must stand ahead of it, since few places have one
    capitals = F.regexp_replace(held, rf"(\p{{Lu}})(?<![\p{{L}}\p{{M}}\p{{Nd}}{UNIT}]\p{{Lu}})(\p{{Ll}}+)", f"{START}$1$2")
    return F.lower(F.regexp_replace(capitals, rf"{START}(?<=[\p{{Ll}}\p{{Nd}},;]\x20{START})", NAME))


def values(mark: Column) -> Column:
    """The tokens of a marked text with their marks."""
    return F.regexp_extract_all(mark, F.lit(_TOKEN), F.lit(0))


def forms(mark: Column) -> Column:
    """The readings of names of several words: (form 0, tokens), and (form 1, tokens) where there are such names."""
    several = F.rlike(mark, F.lit(f"{NAME}{_WORD} {NAME}"))
    joined = F.regexp_replace(mark, f"({NAME}{_WORD}) (?={NAME})", f"$1{JOIN}")
    form = lambda k, m: F.struct(F.lit(k).alias("form"), values(m).alias("tokens"))
    return F.when(several, F.array(form(0, mark), form(1, joined))).otherwise(F.array(form(0, mark)))


def _bare(token: Column) -> Column:
    return F.when(F.substring(token, 1, 1).isin(*_MARKS), F.substr(token, F.lit(2))).otherwise(token)


def shaped(token: Column, names: str) -> Column:
    """A token as a template has it, with the words behind the marks ``names`` as placeholders."""
    head = F.substring(token, 1, 1)
    # all words without a mark are beyond "a", all else before it
    held = F.when(_bare(token).isin(*NUMBER_WORDS), NUMBER).when(token >= "a", token)
    if names:
        held = held.when(head.isin(*names), NAME)
    return held.when(head.isin(NAME, START, FREE), F.substr(token, F.lit(2))).when(head == UNIT, UNIT).when(token == "%", token).otherwise(NUMBER)


def _reading(names: str):
    return lambda t: shaped(t, names)


#: What counts as a name in four readings of an item; a document has those without FREE.
THEIRS = (NAME, NAME + FREE, NAME + FREE + START, "")


def templates(tokens: Column) -> list[Column]:
    """A document's tokens as text in three readings, each token followed by a space: no names, all capitalised words as names, names."""
    held = F.concat(F.array_join(tokens, " "), F.lit(" "))
    held = F.when(F.rlike(held, F.lit("[0-9]")), F.regexp_replace(F.regexp_replace(held, f"{UNIT}[^ ]+", UNIT), "(?<![^ ])[0-9][^ ]*", NUMBER)).otherwise(held)
    held = F.regexp_replace(held, f"(?<![^ ])[{NAME}{START}]?{_FEW}(?= )", NUMBER)
    names = F.regexp_replace(held, f"{NAME}[^ ]+", NAME)
    capitals = F.regexp_replace(held, f"[{NAME}{START}][^ ]+", NAME)
    return [F.translate(held, NAME + START, ""), capitals, F.translate(names, START, "")]


def window_hashes(tokens: Column, lengths: list[int]) -> Column:
    """Hashes of the windows of all readings by length and place, an empty text's where a window goes beyond the end."""
    held = [F.regexp_extract_all(text, F.lit(f"(?=((?:[^ ]+ ){{{n}}})|)[^ ]+ "), F.lit(1)) for text in templates(tokens) for n in lengths]
    return F.transform(F.concat(*held), lambda w: F.xxhash64(w))


def _is_slot(token: Column) -> Column:
    return token.isin(NAME, UNIT, NUMBER)


def _literals(shape: Column) -> Column:
    return F.size(F.filter(shape, lambda t: ~_is_slot(t)))


def item_tokens(benchmark: DataFrame) -> DataFrame:
    """(item_id, form, raw): tokens of each item, with names that start a sentence told from ordinary words."""
    held = materialise(benchmark.select("item_id", marked(F.col("text")).alias("mark"), F.monotonically_increasing_id().alias("row")).select("item_id", "row", values(F.col("mark")).alias("plain"), forms(F.col("mark")).alias("forms")).where(F.size("plain") > 0))
    each = held.select("row", F.explode("plain").alias("token"))
    words = each.where(F.col("token") >= "a").select(F.col("token").alias("word")).distinct()
    starts = each.where(F.startswith("token", F.lit(START))).select("row", F.substr("token", F.lit(2)).alias("word")).distinct()
    ordinary = starts.join(words, "word", "left_semi").groupBy("row").agg(F.collect_set("word").alias("known"))
    held = held.join(ordinary, "row", "left").withColumn("known", F.array_union(F.coalesce("known", F.array().cast("array<string>")), F.array(*[F.lit(w) for w in STARTERS])))
    named = lambda t: F.array_contains("plain", F.concat(F.lit(NAME), F.substr(t, F.lit(2))))
    free = lambda t: F.startswith(t, F.lit(START)) & (named(t) | ~F.array_contains("known", F.substr(t, F.lit(2))))
    held = held.withColumn("each", F.explode("forms"))
    return held.select("item_id", "each.form", F.transform("each.tokens", lambda t: F.when(free(t), F.concat(F.lit(FREE), F.substr(t, F.lit(2)))).otherwise(t)).alias("raw"))


def item_windows(benchmark: DataFrame, window: int) -> DataFrame:
    """(key, hash, item_id, item_form, at, shape, filled, units, n_windows): distinct windows of each item with their values.

    A unit is the first place of a window as words; ``units`` are those that a window stands for."""
    held = materialise(item_tokens(benchmark))
    places = F.explode(F.sequence(F.lit(0), F.greatest(F.size("raw") - window, F.lit(0)))).alias("at")
    each = held.select("item_id", "form", "raw", places).select("item_id", "form", "at", F.slice("raw", F.col("at") + 1, window).alias("filled"))
    shapes = [F.transform("filled", _reading(n)) for n in THEIRS]
    each = each.withColumns({"strict": _literals(shapes[1]) >= LITERALS, "words": shapes[3]})
    own = Window.partitionBy("item_id", "form")
    # an item of little but names takes part by its words
    each = each.withColumns({"any": F.max("strict").over(own), "unit": F.min("at").over(Window.partitionBy("item_id", "form", "words"))})
    each = each.select("item_id", "form", "at", "unit", "filled", "strict", "any", F.explode(F.array_distinct(F.array(*shapes))).alias("shape")).where(F.col("strict") | (~F.col("any") & (_literals(F.col("shape")) >= LITERALS)))
    first = each.groupBy("item_id", "form", "shape").agg(F.min(F.struct("at", "filled")).alias("x"), F.collect_set("unit").alias("units"))
    key = F.concat(F.array_join("shape", " "), F.lit(" ")).alias("key")
    return first.select("item_id", F.col("form").alias("item_form"), key, F.xxhash64(F.concat(F.array_join("shape", " "), F.lit(" "))).alias("hash"), "shape", F.col("x.at").alias("at"), F.col("x.filled").alias("filled"), "units", F.size(F.array_distinct(F.flatten(F.collect_list("units").over(own)))).alias("n_windows"))


def keywords(items: DataFrame, coverage: float) -> DataFrame:
    """(word, item_id, item_form, k, need): an item's words, the windows that each stands for, and of how many windows a document
    needs the words to be contaminated. ``need`` is 0 or less where windows without a word could be enough."""
    words = F.filter("shape", lambda t: ~_is_slot(t) & (t != "%"))
    each = items.select("item_id", "item_form", "n_windows", F.explode("units").alias("unit"), words.alias("words"))
    held = each.groupBy("item_id", "item_form", "unit").agg(F.first("n_windows").alias("n"), F.collect_list("words").alias("all"))
    # words that stand for themselves in all readings of the window
    common = F.aggregate(F.slice("all", 2, F.size("all")), F.get("all", 0), lambda a, x: F.array_intersect(a, x))
    best = F.array_max(F.transform(common, lambda w: F.struct(F.length(w).alias("size"), w.alias("word"))))
    held = held.select("item_id", "item_form", "n", best["word"].alias("word"))
    own = Window.partitionBy("item_id", "item_form")
    held = held.withColumn("need", F.ceil(F.col("n") * coverage) - F.count(F.when(F.col("word").isNull(), 1)).over(own))
    return held.groupBy("word", "item_id", "item_form", "need").agg(F.count(F.lit(1)).alias("k"))


def _broadcast_if_small(df: DataFrame, size: Column) -> DataFrame:
    return F.broadcast(df) if (df.agg(F.sum(size)).first()[0] or 0) <= BROADCAST_BYTES else df


def possible(docs: DataFrame, words: DataFrame) -> DataFrame:
    """Rows of (doc_id, row_mark, text) with as many of an item's words as contamination takes; all rows where an item needs none."""
    least = words.agg(F.min(F.length("word")).alias("n"), F.min("need").alias("need")).first()
    if least["n"] is None or least["need"] <= 0:
        return docs
    own = F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(rf"[\p{{L}}\p{{M}}]{{{least['n']},}}"), F.lit(0)))).alias("word")
    hits = docs.select("doc_id", "row_mark", own).join(_broadcast_if_small(words, F.octet_length("word") + 60), "word")
    found = hits.groupBy("doc_id", "row_mark", "item_id", "item_form").agg(F.sum("k").alias("k"), F.first("need").alias("need")).where("k >= need")
    found = materialise(found.select(F.col("doc_id").alias("_found"), F.col("row_mark").alias("_mark")).distinct())
    return docs.join(_broadcast_if_small(found, F.lit(50)), F.col("doc_id").eqNullSafe(F.col("_found")) & (F.col("row_mark") == F.col("_mark")), "left_semi")


def _hits(cut: DataFrame, items: DataFrame, lengths: list[int], small: bool) -> DataFrame:
    """Windows of the stretches ``cut`` that have the hash of an item's, with both sides' values."""
    ids, size = ["doc_id", "row_mark", "doc_form", "from"], F.size("tokens")
    theirs = ["item_id", "item_form", "n_windows", "at", "units", "key", "shape", "filled"]
    windows = F.posexplode(window_hashes(F.col("tokens"), lengths)).alias("nth", "window")
    if small:
        found = cut.select(*ids, "tokens", windows).join(F.broadcast(items), F.col("window") == F.col("hash"))
    else:
        cut = materialise(cut.withColumn("stretch", F.monotonically_increasing_id()))
        hashes = items.select("hash").distinct()
        few = materialise(cut.select("stretch", windows).join(hashes, F.col("window") == F.col("hash"), "left_semi"))
        found = few.join(items, F.col("window") == F.col("hash")).join(cut, "stretch")
    place = F.col("nth") % size
    return found.select("doc_id", "row_mark", "doc_form", *theirs, (F.col("from") + place).alias("place"), F.floor(F.col("nth") / (size * len(lengths))).cast("int").alias("reading"), F.slice("tokens", place + 1, F.size("shape")).alias("ours"))


def find(docs: DataFrame, benchmark: DataFrame, window: int = 5, coverage: float = 0.5) -> DataFrame:
    """(doc_id, mark, item_id, found, n_windows) of each document and the items that contaminate it."""
    items = materialise(item_windows(benchmark, window))
    lengths = sorted(r["n"] for r in items.select(F.size("shape").alias("n")).distinct().collect()) or [window]
    words = materialise(keywords(items, coverage))
    weight = F.octet_length("key") + F.octet_length(F.array_join("filled", " ")) + 8 * F.size("units") + 24 * F.size("shape") + 100
    small = (items.agg(F.sum(weight)).first()[0] or 0) <= BROADCAST_BYTES
    texts = possible(docs.select("doc_id", F.hash(F.coalesce("text", F.lit(""))).alias("row_mark"), "text"), words)
    texts = texts.select("doc_id", "row_mark", marked(F.col("text")).alias("mark"))
    cut = texts.select("doc_id", "row_mark", F.explode_outer(forms(F.col("mark"))).alias("x")).select("doc_id", "row_mark", F.col("x.form").alias("doc_form"), F.col("x.tokens").alias("all"))
    cut = cut.select("doc_id", "row_mark", "doc_form", "all", F.explode(F.sequence(F.lit(0), F.greatest(F.size("all") - 1, F.lit(0)), F.lit(STRETCH))).alias("from"))
    cut = cut.select("doc_id", "row_mark", "doc_form", "from", F.slice("all", F.col("from") + 1, STRETCH + max(lengths) - 1).alias("tokens"))
    # hits are written: else the tests below would become part of the join's condition, for which every window's row,
    # with the tokens of its stretch, would be copied
    hits = materialise(_hits(cut, items, lengths, small))
    hits = hits.where(F.get(F.array(*templates(F.col("ours"))), "reading") == F.col("key"))
    pairs = F.zip_with(F.arrays_zip("shape", "filled"), F.col("ours"), lambda a, b: F.struct(a["shape"].alias("kind"), F.substring(a["filled"], 1, 1).alias("head"), _bare(a["filled"]).alias("theirs"), _bare(b).alias("ours")))
    hits = hits.withColumn("pairs", F.filter(pairs, lambda p: _is_slot(p["kind"])))
    # ordinary words stand for themselves
    hits = hits.where(F.forall("pairs", lambda p: (p["head"] != START) | (p["theirs"] == p["ours"])))
    both = ["doc_id", "row_mark", "doc_form", "item_id", "item_form"]
    hits = hits.select(*both, "n_windows", "units", (F.col("place") - F.col("at")).alias("shift"), F.forall("pairs", lambda p: p["theirs"] == p["ours"]).alias("same"), F.transform("pairs", lambda p: F.struct(p["kind"].alias("kind"), p["theirs"].alias("theirs"), p["ours"].alias("ours"))).alias("pairs"))
    aligned = hits.groupBy(*both, "shift").agg(F.first("n_windows").alias("n_windows"), F.array_distinct(F.flatten(F.collect_set(F.when(F.col("same"), F.col("units"))))).alias("plain"), F.array_distinct(F.flatten(F.collect_set(F.when(~F.col("same"), F.col("units"))))).alias("slotted"), F.array_distinct(F.flatten(F.collect_set("pairs"))).alias("pairs"))
    consistent = F.size(F.array_distinct(F.transform("pairs", lambda p: F.struct(p["kind"], p["theirs"])))) == F.size("pairs")
    counted = aligned.select(*both, "n_windows", F.when(consistent, F.array_union("plain", "slotted")).otherwise(F.col("plain")).alias("units"))
    found = counted.groupBy(*both).agg(F.first("n_windows").alias("n_windows"), F.size(F.array_distinct(F.flatten(F.collect_list("units")))).alias("found"))
    best = found.where(F.col("found") >= coverage * F.col("n_windows")).groupBy("doc_id", "row_mark", "item_id").agg(F.max(F.struct(F.col("found") / F.col("n_windows"), "found", "n_windows")).alias("x"))
    return best.select("doc_id", "row_mark", "item_id", "x.n_windows", "x.found")


def _matches():
    return F.col("_key").eqNullSafe(F.col("_found")) & (F.col("_mark") == F.col("row_mark"))


def judge(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """doc_id, contaminated, n_items and item_ids of every row of ``docs``."""
    found = find(docs, benchmark, **how).groupBy(F.col("doc_id").alias("_found"), "row_mark").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"), F.count(F.lit(1)).alias("n"))
    rows = docs.select(F.col("doc_id").alias("_key"), F.hash(F.coalesce("text", F.lit(""))).alias("_mark"))
    out = rows.join(found, _matches(), "left")
    return out.select(F.col("_key").alias("doc_id"), F.col("n").isNotNull().alias("contaminated"), F.coalesce("n", F.lit(0)).alias("n_items"), F.coalesce("item_ids", F.array().cast("array<long>")).alias("item_ids"))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """``docs`` without contaminated rows; all columns and other rows stay."""
    found = find(docs.select("doc_id", "text"), benchmark, **how).select(F.col("doc_id").alias("_found"), "row_mark").distinct()
    own = docs.drop(*[c for c in docs.columns if c in ("_key", "_mark", "_found", "row_mark")])
    rows = own.withColumns({"_key": F.col("doc_id"), "_mark": F.hash(F.coalesce("text", F.lit("")))})
    return rows.join(found, _matches(), "left_anti").drop("_key", "_mark")
