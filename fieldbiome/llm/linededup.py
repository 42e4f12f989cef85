"""Line dedup by a deletion-neighbourhood join over words, in DataFrame functions only.

A line with a word is dropped if an earlier line (by doc_id, then place in the text) equals it, or, where both have at least
min_words words, turns into it by inserting, deleting or replacing one word. The earlier line may itself be dropped. Lines
compare by their words, so white space doesn't count; blank lines stay. min_words is a parameter (10: shorter lines are often
alike by chance); with 1, all lines match nearly.

How: equal lines meet by hash, and the earliest of each stands for all. Two lines one edit apart agree in all words before and
after some gap, so lines go on only if they share what lies around one of a few gaps that cover the line (two halves first, then
eighths) with another line: this drops no pair. Those left emit the hashed keys of the variants within the bound: the line itself
and the line without its k-th word, for each k in a shared gap. A replacement shares a deletion variant of the same place; an
insertion makes one line the other's deletion variant. In both cases all lines of a key are one edit from its earliest (or from
the line itself), so joining each variant with the earliest of its key finds an earlier partner if there is any, without pairs of
a group. Found partners are verified on their words.

Variant keys are two 64-bit hashes, exclusive ors of hashes of (word, place): with running ones of f(word, place) and of
f(word, place - 1), each of a line's variants costs one operation, however long the line.

Defined results: a null text has no lines and stays null; an empty text stays empty. Rows with equal doc_id and text count as one
document and get the same verdicts; rows of one doc_id with other texts follow each other in the order of a text hash. An empty
table gives an empty result. Rows without a doc_id stay as they are and make no other line a duplicate. Extra columns pass
through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldbiome.llm.common import SPACE_CHARS, SPACE_RUN, cut, free_name, let, release

#: Lines of fewer words only match exactly, unless asked for; gaps of the first and the second look; growth of the size classes of lines.
MIN_WORDS, HALVES, EIGHTHS, CLASS_GROWTH = 10, 2, 8, 1.125
#: Slots of the broadcast filter of lines, 64 to a row: 2^18 rows (a few MB) at most, whatever the input. It only saves shuffle:
#: where it is full, every line meets the join behind it.
FILTER_SLOTS = 1 << 24


def _has_word(line: Column) -> Column:
    return F.btrim(line, F.lit(SPACE_CHARS)) != ""


def _words_alone(line: Column) -> Column:
    """A line's words with one space between them. Most lines have no other white space and need no pattern."""
    odd = line.contains("  ")
    for c in SPACE_CHARS.replace(" ", "").replace("\n", ""):
        odd = odd | line.contains(c)
    return F.when(odd, F.regexp_replace(F.btrim(line, F.lit(SPACE_CHARS)), SPACE_RUN, " ")).otherwise(F.trim(line))


def _count(words: Column) -> Column:
    """The number of words of a line of lone spaces that isn't empty."""
    return F.length(words) - F.length(F.replace(words, F.lit(" "), F.lit(""))) + 1


def _lines(docs: DataFrame) -> DataFrame:
    """One row for each line: at (doc_id, place, and a hash that tells rows of one doc_id apart), line."""
    base = docs.where("text is not null and doc_id is not null").select("doc_id", F.xxhash64("text").alias("row"), F.posexplode(F.split("text", "\n")).alias("place", "line"))
    return base.select(F.struct("doc_id", "place", "row").alias("at"), "line")


def _least_of_class(n: Column, min_words: int) -> Column:
    """The least number of words of n's size class."""
    grown = F.floor(F.log(n / float(min_words)) / F.log(F.lit(CLASS_GROWTH)) + 1e-9)
    return F.floor(min_words * F.pow(F.lit(CLASS_GROWTH), grown)).cast("int")


def _around(words: Column, n: Column, least: Column, gaps: int) -> list[tuple[Column, Column, Column]]:
    """For each gap of a size class from `least` words on: (hash of the words around it, its first place, the place after it).

    Gap j leaves j * (least // gaps) words before it and the other (gaps - 1 - j) * (least // gaps) after it, so the gaps
    cover every place of a line of the class, and lines one edit apart see equal surroundings of some gap.
    """
    step = F.floor(least / gaps).cast("int")
    out = []
    for j in range(gaps):
        lo, tail = j * step, (gaps - 1 - j) * step
        sides = [F.call_function("substring_index", words, F.lit(" "), x) for x, held in ((lo, j), (-tail, gaps - 1 - j)) if held]
        out.append((F.xxhash64(least, F.lit(j), F.lit(gaps), *sides), lo, n - tail))
    return out


def _with_classes(rows: DataFrame, min_words: int) -> DataFrame:
    """rows (words, n, ...) with own and below: the size class, and for lines that open one, the class below (else null)."""
    own, below = _least_of_class(F.col("n"), min_words), _least_of_class(F.col("n") - 1, min_words)
    near = F.col("n") >= min_words
    return rows.withColumn("own", F.when(near, own)).withColumn("below", F.when(near & (F.col("n") > min_words) & (below < own), below))


def found(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """One row for each line to drop: doc_id, row, place, exact (an equal line is earlier; else one within one edit)."""
    words = _lines(docs).select("at", _words_alone(F.col("line")).alias("words")).where("words <> ''")
    words = _with_classes(words.withColumn("n", _count(F.col("words"))), min_words)
    k1, k2 = F.xxhash64(F.lit(1), "words"), F.xxhash64(F.lit(2), "words")
    halves = [F.when(F.col(c).isNotNull(), h) for c in ("own", "below") for h, _, _ in _around(F.col("words"), F.col("n"), F.col(c), HALVES)]
    facts = cut(words.select("at", "n", k1.alias("k1"), k2.alias("k2"), F.array_compact(F.array(*halves)).alias("ends")), "lines")
    first = facts.groupBy("k1", "k2").agg(F.min(F.struct("at", "n", "ends")).alias("x"), F.count("*").alias("copies"))
    first = cut(first.select(F.col("k1").alias("f1"), F.col("k2").alias("f2"), "x.at", "x.n", "x.ends", "copies"), "firsts")
    own = first.where("copies > 1").select("f1", "f2", F.col("at").alias("first_at"))
    exact = cut(facts.select("at", "k1", "k2").join(own, (F.col("k1") == F.col("f1")) & (F.col("k2") == F.col("f2"))).where("at > first_at").select("at"), "exact")
    release(facts)

    # First look: lines that share the half around one of two gaps.
    long_ = first.where(F.col("n") >= min_words)
    alike = cut(_sharing(long_.select("at", "f1", "f2", F.explode("ends").alias("h")), "h").select("at", "f1", "f2").distinct(), "alike")
    release(first)
    # Their words, from the documents. A filter of FILTER_SLOTS bits keeps other lines out of the shuffle.
    slot = lambda at: F.pmod(F.xxhash64(at), F.lit(FILTER_SLOTS)).cast("int")
    bit = lambda at: F.call_function("shiftleft", F.lit(1).cast("long"), slot(at).bitwiseAND(63))
    filter_ = alike.groupBy(F.shiftright(slot(F.col("at")), 6).alias("word")).agg(F.bit_or(bit(F.col("at"))).alias("bits"))
    texts = _lines(docs).select(F.col("at").alias("of"), "line").withColumn("w", F.shiftright(slot(F.col("of")), 6))
    texts = texts.join(F.broadcast(filter_), F.col("w") == F.col("word")).where(F.col("bits").bitwiseAND(bit(F.col("of"))) != 0).select("of", "line")
    # Rows with one doc_id and one text make equal (of, line) pairs: one of each goes on.
    lines = alike.join(texts, F.col("at") == F.col("of")).select("at", "f1", "f2", _words_alone(F.col("line")).alias("words")).dropDuplicates(["f1", "f2"])
    lines = cut(lines.withColumn("n", _count(F.col("words"))), "alike")
    release(alike)
    near = _one_edit(lines, min_words)
    # Only the earliest of equal lines needs the verdict: the others are dropped as exact copies anyway.
    out = exact.select("at", F.lit(True).alias("exact")).union(near.select("at", F.lit(False).alias("exact")))
    out = cut(out.select("at.doc_id", "at.row", "at.place", "exact"), "found")
    release(exact, near)
    return out


def _sharing(rows: DataFrame, key: str) -> DataFrame:
    """The rows whose key another row has too; the join sees each key's count, not its rows."""
    shared = rows.groupBy(key).agg(F.count("*").alias("c")).where("c > 1").select(F.col(key).alias("__key"))
    return rows.join(shared, F.col(key) == F.col("__key"), "left_semi")


def _variants(lines: DataFrame, min_words: int) -> DataFrame:
    """(f1, f2, at, p, n, h1, h2) of each deletion variant in a gap that another line shares, and of each whole line (p: -1).

    The second look, by eighths, says where the edit may be. Lines stay dealt by (f1, f2) from its join to the running keys.
    """
    classed = _with_classes(lines, min_words)
    gaps = F.array(*[F.when(F.col(c).isNotNull(), F.struct(h.alias("h"), lo.alias("lo"), hi.alias("hi"))) for c in ("own", "below") for h, lo, hi in _around(F.col("words"), F.col("n"), F.col(c), EIGHTHS)])
    gaps = classed.select("f1", "f2", F.explode(F.array_compact(gaps)).alias("g")).select("f1", "f2", "g.h", "g.lo", "g.hi")
    gaps = cut(gaps, "gaps")
    shared = _sharing(gaps, "h").groupBy("f1", "f2").agg(F.collect_set(F.struct("lo", "hi")).alias("gaps"))
    word = lines.join(shared, ["f1", "f2"]).select("at", "n", "f1", "f2", "gaps", F.posexplode(F.split("words", " ")).alias("p", "w"))
    open_ = F.exists("gaps", lambda g: (F.col("p") >= g["lo"]) & (F.col("p") < g["hi"]))
    f = lambda k, place: F.xxhash64(F.lit(k), F.col("w"), place)
    hashes = [f(k, F.col("p") - back).alias(f"{name}{k}") for k in (1, 2) for name, back in (("here", 0), ("left", 1))]
    word = word.select("at", "n", "f1", "f2", "p", open_.alias("open"), *hashes)
    line = Window.partitionBy("f1", "f2")
    upto = line.orderBy("p").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    for k in (1, 2):
        word = word.withColumn(f"a{k}", F.bit_xor(f"here{k}").over(upto)).withColumn(f"b{k}", F.bit_xor(f"left{k}").over(upto))
    for k in (1, 2):
        word = word.withColumn(f"all{k}", F.bit_xor(f"left{k}").over(whole))
    # Without word p: what stands before it, at its place, and what stands after it, one place to the left.
    cut_out = [F.col(f"a{k}").bitwiseXOR(F.col(f"here{k}")).bitwiseXOR(F.col(f"all{k}")).bitwiseXOR(F.col(f"b{k}")).alias(f"h{k}") for k in (1, 2)]
    kept = F.array(
        F.when(F.col("open"), F.struct("p", (F.col("n") - 1).alias("n"), *cut_out)),
        F.when(F.col("p") == F.col("n") - 1, F.struct(F.lit(-1).alias("p"), F.col("n"), F.col("a1").alias("h1"), F.col("a2").alias("h2"))),
    )
    emitted = cut(word.select("f1", "f2", "at", F.explode(F.array_compact(kept)).alias("v")).select("f1", "f2", "at", "v.*"), "variants")
    release(gaps)
    return emitted


def _one_edit(lines: DataFrame, min_words: int) -> DataFrame:
    """Of distinct lines (at, n, f1, f2, words), those (at) with an earlier line one word edit away. Removes lines' files."""
    emitted = _variants(lines, min_words)
    owner = F.struct("at", "f1", "f2")
    same = (F.col("n") == F.col("n_")) & (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2"))
    key = (F.col("n").alias("n_"), F.col("h1").alias("g1"), F.col("h2").alias("g2"))
    deletions = emitted.where("p >= 0")
    # Replacements: the earliest line of each (variant, place). Insertions: each variant meets the line that it equals.
    least = cut(deletions.groupBy("n", "h1", "h2", "p").agg(F.min(owner).alias("x"), F.count("*").alias("c")).where("c > 1").select(*key, F.col("p").alias("p_"), "x"), "least")
    replaced = deletions.join(least, same & (F.col("p") == F.col("p_"))).where("x.at < at").select("at", "f1", "f2", "p", "x", F.lit("replace").alias("how"))
    # A line of which another is a deletion variant comes after that one, or before: only the earliest owner matters.
    wholes = cut(emitted.where("p < 0").where(F.col("n") >= min_words).select(*key, owner.alias("x")), "wholes")
    deleted = cut(deletions.join(wholes, same, "left_semi").groupBy("n", "h1", "h2").agg(F.min(F.struct("at", "f1", "f2", "p")).alias("y")), "deleted")
    shorter = deleted.join(wholes, same).where("y.at < x.at").select("x.at", "x.f1", "x.f2", "y.p", F.struct("y.at", "y.f1", "y.f2").alias("x"), F.lit("delete").alias("how"))
    longer = deletions.join(wholes, same).where("x.at < at").select("at", "f1", "f2", "p", "x", F.lit("insert").alias("how"))
    pairs = replaced.union(shorter).union(longer).groupBy("at", "f1", "f2", "how").agg(F.min(F.struct("x", "p")).alias("m"))
    pairs = cut(pairs.select("at", "f1", "f2", "how", F.col("m.x.f1").alias("g1"), F.col("m.x.f2").alias("g2"), F.col("m.p").alias("p")), "pairs")
    release(emitted, least, wholes, deleted)
    mine = lines.select("f1", "f2", F.split("words", " ").alias("u"))
    theirs = lines.select(F.col("f1").alias("g1"), F.col("f2").alias("g2"), F.split("words", " ").alias("v"))
    held = pairs.join(mine, ["f1", "f2"]).join(theirs, ["g1", "g2"])
    near = cut(held.where(_verified(F.col("u"), F.col("v"), F.col("p"), F.col("how"))).select("at").distinct(), "near")
    release(pairs, lines)
    return near


def _without(words: Column, place: Column) -> Column:
    """words without the one at a place (from 0), as an array."""
    n = F.size(words)
    return F.concat(F.slice(words, F.lit(1), place), F.when(place + 1 < n, F.slice(words, place + 2, n)).otherwise(F.array().cast("array<string>")))


def _verified(mine: Column, theirs: Column, place: Column, how: Column) -> Column:
    """Whether one word edit at a place really turns one line into the other: compared word by word."""
    return (
        F.when(how == "replace", _without(mine, place) == _without(theirs, place))
        .when(how == "insert", _without(mine, place) == theirs)
        .otherwise(_without(theirs, place) == mine)
    )


def clean(docs: DataFrame, min_words: int = MIN_WORDS, name: str = "__lines") -> DataFrame:
    """docs with the duplicate lines cut out of text, and a struct column `name`: n_lines, n_exact, n_near (lines with a word)."""
    if name.lower() in (c.lower() for c in docs.columns):
        raise ValueError(f"docs has a column {name}: give another name")
    d, r, places, n_exact = (free_name(docs, x) for x in ("__doc", "__row", "__places", "__n_exact"))
    dropped = found(docs, min_words)
    gone = cut(dropped.groupBy(F.col("doc_id").alias(d), F.col("row").alias(r)).agg(F.collect_set("place").alias(places), F.sum(F.col("exact").cast("long")).alias(n_exact)), "gone")
    release(dropped)
    joined = docs.join(gone, (docs["doc_id"] == gone[d]) & (F.xxhash64(docs["text"]) == gone[r]), "left")
    parts = F.split(docs["text"], "\n")
    left = lambda ps: F.transform(F.array_except(F.sequence(F.lit(0), F.size(ps) - 1), gone[places]), lambda i: F.get(ps, i))
    kept = F.when(gone[places].isNull(), docs["text"]).otherwise(F.array_join(let(parts, left), "\n"))
    n = F.coalesce(F.size(F.filter(parts, _has_word)), F.lit(0))
    n = F.when(docs["text"].isNull(), F.lit(0)).otherwise(n)
    exact = F.coalesce(gone[n_exact], F.lit(0))
    facts = F.struct(n.cast("long").alias("n_lines"), exact.cast("long").alias("n_exact"), (F.when(gone[places].isNull(), 0).otherwise(F.size(gone[places])) - exact).cast("long").alias("n_near"))
    return joined.select(*[docs[c] if c != "text" else kept.alias("text") for c in docs.columns], facts.alias(name))


def drop_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with duplicate lines cut out; documents of which no line with a word is left go. n_chars, if there, follows text."""
    name = free_name(docs, "__lines")
    out = clean(docs, min_words, name)
    s = F.col(name)
    out = out.where((s["n_lines"] == 0) | (s["n_lines"] > s["n_exact"] + s["n_near"])).drop(name)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
