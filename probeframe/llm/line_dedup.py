"""Line dedup by a deletion-neighbourhood join, with DataFrame functions only.

A line is the sequence of its words (runs of anything but \\x20 and \\x09-\\x0D); a line without words is never removed.
The edit distance counts inserted, deleted or replaced units: words where a line has ``least`` of them or more, else characters
(of its words joined by one space). Lines compare as sequences of one kind of unit. The bound is one edit, and no more than one
for each ``least`` units, so lines of fewer than ``least`` characters are compared for equality. A line is removed if and only if
an earlier line - by (doc_id, text, line number) - of any document is within the bound; this is judged on the input, so the order
of removals does not matter.

How it stays linear: lines are first reduced to distinct sequences with their earliest place. One edit leaves the first or the
last half of a line as it was, so only sequences that share a half with another one emit variants (all others cannot have a
neighbour). A variant is the hash of the line without one unit. Equal variants meet in a pre-aggregated minimum of their places
instead of in pairs: variants by position link replaced units, variants without position link a line to the line that lacks
one unit. The distance to the earliest partner found is then verified on the units.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import only_listed, saved

#: Units that a line has at least for one edit.
LEAST = 8


def _normal(line: Column) -> Column:
    """The words of a line, joined by one space."""
    odd = reduce(or_, [F.contains(line, F.lit(x)) for x in ("  ", "\t", "\x0b", "\x0c", "\r")])
    return F.trim(F.when(odd, F.regexp_replace(line, r"[\x20\x09\x0B-\x0D]+", " ")).otherwise(line))


def _hashes(norm: str) -> tuple[Column, Column]:
    """Two hashes that identify a sequence of words."""
    return F.xxhash64(norm).alias("h"), F.xxhash64(F.lit(1), norm).alias("g")


def _halves(lines: DataFrame, least: int) -> DataFrame:
    """lines (norm, ...) with kind (0 words, 1 characters), m (units; 0: equality only) and halves: hashes of the first and last
    halves, three for each line; two lines one edit apart have one in common."""
    words = F.octet_length("norm") - F.octet_length(F.replace(F.col("norm"), F.lit(" "))) + 1
    lines = lines.withColumn("w", words).withColumn("c", F.when(F.col("w") >= least, F.col("w")).otherwise(F.char_length("norm")))
    lines = lines.withColumn("kind", F.expr(f"int(w < {least})")).withColumn("m", F.expr(f"if(c >= {least}, c, 0)")).withColumn("o", F.expr("int((m - 1) / 2)"))
    lines = lines.withColumn("i", F.expr("int(m / 2)"))

    def half(side: int, n: str) -> str:
        part = f"if(kind = 0, substring_index(norm, ' ', {n}), left(norm, {n}))" if side == 0 else f"if(kind = 0, substring_index(norm, ' ', -({n})), right(norm, {n}))"
        return f"xxhash64({side}, kind, {n}, {part})"

    even = f"if(m % 2 = 0, {half(0, 'o')}, {half(1, 'm - 1 - o')})"
    return lines.withColumn("halves", F.expr(f"if(m > 0, array({half(0, 'i')}, {half(1, 'm - i')}, {even}), null)")).drop("w", "c", "o", "i")


def removed_lines(docs: DataFrame, max_edits: int = 1, least: int = LEAST) -> DataFrame:
    """(doc_id, t, line_no) of the lines that go; t is xxhash64 of the row's text. max_edits 0 leaves equal lines only; 1 is the
    production setting.

    Null text: no lines. Rows without doc_id take no part. Other columns of docs are not looked at. Rows of one doc_id with
    different texts are rows of their own, in the order of t; equal rows are one place, so they keep the same lines.
    """
    if max_edits not in (0, 1):
        raise ValueError("max_edits is 0 or 1")
    docs = docs.where("doc_id is not null and text is not null").select("doc_id", F.xxhash64("text").alias("t"), "text")
    lines = docs.select("doc_id", "t", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).select("doc_id", "t", "line_no", _normal(F.col("line")).alias("norm"))
    lines = _halves(lines.where("norm <> ''"), least)
    known = saved(lines.select("doc_id", "t", "line_no", *_hashes("norm"), "kind", "m", "halves"), "lines")
    place = F.struct("doc_id", "t", "line_no")
    seqs = known.groupBy("h", "g", "kind", "m").agg(F.min(place).alias("place"), F.count("*").alias("n"), F.first("halves").alias("halves"))
    seqs = saved(seqs, "lines-distinct")
    best = seqs.where("n > 1").select("h", "g", F.col("place").alias("best"))
    if max_edits:
        near = _near(docs, seqs)
        best = best.union(near).groupBy("h", "g").agg(F.min("best").alias("best"))
    best = saved(best, "lines-best")
    gone = known.select("doc_id", "t", "line_no", "h", "g").join(best, ["h", "g"]).where(place > F.col("best"))
    return gone.select("doc_id", "t", "line_no")


def _zobrist(words: Column, seed: int, shift: int = 0) -> Column:
    """A hash of each unit with its kind and place."""
    return F.transform(words, lambda w, i: F.xxhash64(F.lit(seed), F.col("kind"), w, i + shift))


def _xor(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(x))


def _near(docs: DataFrame, seqs: DataFrame) -> DataFrame:
    """(h, g, best): the earliest place of a sequence within one edit, where that is earlier than the sequence itself.

    A sequence emits variants only for the kinds of partners that share a half with it: replaced words where one has as many
    words, missing words where one has a word less. The variants of a line are its hash (an exclusive or of the hashes of
    words with their places) without one word, so each costs one step.
    """
    keys = seqs.where("m > 0").select("h", "g", "m", F.explode("halves").alias("half"))
    shared = keys.groupBy("half").agg(F.count("*").alias("c")).where("c > 1").select("half")
    keys = saved(keys.join(shared, "half"), "lines-halves")
    sizes = keys.groupBy("half", "m").agg(F.count("*").alias("c"))
    alike = sizes.where("c > 1").select("half", "m", F.lit(1).alias("kind"))
    less = sizes.select("half", (F.col("m") + 1).alias("m")).join(sizes.select("half", "m"), ["half", "m"])
    kinds = alike.union(less.select("half", "m", F.lit(2))).union(less.select("half", F.col("m") - 1, F.lit(4)))
    listed = keys.join(kinds, ["half", "m"]).groupBy("h", "g").agg(*[F.max(F.when(F.col("kind") == k, True).otherwise(False)).alias(n) for k, n in ((1, "alike"), (2, "longer"), (4, "shorter"))])
    listed = saved(listed.join(seqs.select("h", "g", "kind", "place"), ["h", "g"]), "lines-listed")
    wanted = saved(listed.groupBy("place.doc_id", "place.t").agg(F.collect_list(F.struct("place.line_no", "h", "g", "kind", "place", "alike", "longer", "shorter")).alias("at")), "lines-wanted")
    found = only_listed(docs, wanted.select("doc_id").distinct(), "doc_id").dropDuplicates(["doc_id", "t"]).join(wanted, ["doc_id", "t"])
    found = found.select(F.split("text", "\n").alias("parts"), F.explode("at").alias("x"))
    found = found.select("x.*", _normal(F.element_at("parts", F.col("x.line_no") + 1)).alias("norm")).drop("line_no")
    texts = found.withColumn("words", F.when(F.col("kind") == 0, F.split("norm", " ")).otherwise(F.split("norm", ""))).drop("norm")
    texts = saved(texts, "lines-texts")
    who = F.struct("place", "h", "g")

    zs = texts.where("alike").select("h", "g", "place", _zobrist(F.col("words"), 1).alias("z"), _zobrist(F.col("words"), 2).alias("y"))
    zs = zs.select("h", "g", "place", "z", "y", _xor(F.col("z")).alias("zz"), _xor(F.col("y")).alias("yy"))
    each = zs.select("h", "g", "place", "zz", "yy", F.posexplode(F.arrays_zip("z", "y")).alias("i", "v"))
    each = each.select("h", "g", "place", "i", F.col("zz").bitwiseXOR(F.col("v.z")).alias("k"), F.col("yy").bitwiseXOR(F.col("v.y")).alias("l"))
    first = each.groupBy("k", "l", "i").agg(F.min(who).alias("p"), F.count("*").alias("c")).where("c > 1").drop("c")
    replaced = each.join(first, ["k", "l", "i"]).where("p.place < place").select("h", "g", "p")

    def whole(seed: int) -> Column:
        return _xor(_zobrist(F.col("words"), seed))

    def without(seed: int) -> Column:
        """For each place the hash of the line without its word there: words before it at their places, the others one earlier."""
        start = F.struct(F.lit(0).cast("long").alias("before"), _xor(_zobrist(F.col("words"), seed, -1)).alias("after"), F.array().cast("array<bigint>").alias("out"))
        both = F.arrays_zip(_zobrist(F.col("words"), seed).alias("a"), _zobrist(F.col("words"), seed, -1).alias("b"))

        def step(acc: Column, x: Column) -> Column:
            after = acc["after"].bitwiseXOR(x["b"])
            return F.struct(acc["before"].bitwiseXOR(x["a"]).alias("before"), after.alias("after"), F.concat(acc["out"], F.array(acc["before"].bitwiseXOR(after))).alias("out"))

        return F.aggregate(both, start, step, lambda acc: acc["out"])

    rests = texts.where("longer").select("h", "g", "place", F.explode(F.arrays_zip(without(1).alias("k"), without(2).alias("l"))).alias("v")).select("h", "g", "place", "v.k", "v.l")
    wholes = texts.where("shorter").select(whole(1).alias("k"), whole(2).alias("l"), who.alias("q"))
    pairs = saved(rests.groupBy("k", "l").agg(F.min(who).alias("p")).join(wholes, ["k", "l"]), "lines-pairs")
    shorter = pairs.where("p.place < q.place").select("q.h", "q.g", "p")
    longer = rests.join(pairs.select("k", "l", "q"), ["k", "l"]).where("q.place < place").select("h", "g", F.col("q").alias("p"))
    found = replaced.union(shorter).union(longer).groupBy("h", "g").agg(F.min("p").alias("p"))
    found = found.select("h", "g", F.col("p.h").alias("ph"), F.col("p.g").alias("pg"), F.col("p.place").alias("best"))
    own = texts.select("h", "g", "words")
    other = texts.select(F.col("h").alias("ph"), F.col("g").alias("pg"), F.col("words").alias("others"))
    verified = found.join(own, ["h", "g"]).join(other, ["ph", "pg"]).where(one_edit("words", "others"))
    return verified.select("h", "g", "best")


def one_edit(a: str, b: str) -> Column:
    """Whether the word arrays a and b are exactly one inserted, deleted or replaced word apart."""
    p = f"int(array_position(zip_with({a}, {b}, (x, y) -> not (x <=> y)), true))"

    def rest(of: str) -> str:
        return f"concat(slice({of}, 1, p - 1), slice({of}, p + 1, size({of})))"

    test = (
        f"case when size({a}) = size({b}) then slice({a}, p + 1, size({a})) = slice({b}, p + 1, size({b})) "
        f"when size({a}) = size({b}) + 1 then {rest(a)} = {b} when size({b}) = size({a}) + 1 then {rest(b)} = {a} else false end"
    )
    return F.expr(f"exists(array({p}), p -> p > 0 and ({test}))")


def dedup_lines(docs: DataFrame, max_edits: int = 1, least: int = LEAST) -> DataFrame:
    """docs with ``text`` cut down to the kept lines, and n_lines, n_removed (lines with words) beside their other columns.

    A document that loses every line with words has an empty text; a document that loses none keeps its text byte for byte.
    Rows without doc_id keep theirs.
    """
    if clash := {"n_lines", "n_removed", "__gone"} & set(docs.columns):
        docs = docs.drop(*clash)
    gone = removed_lines(docs, max_edits, least).groupBy(F.col("doc_id").alias("__i"), F.col("t").alias("__t")).agg(F.collect_set("line_no").alias("__gone"))
    both = docs.join(gone, (F.col("doc_id") == F.col("__i")) & (F.xxhash64("text") == F.col("__t")), "left").drop("__i", "__t")
    kept = F.array_join(F.filter(F.split("text", "\n"), lambda line, i: ~F.array_contains("__gone", i)), "\n")
    both = both.withColumn("n_lines", F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D][^\n]*")), F.lit(0)))
    both = both.withColumn("n_removed", F.coalesce(F.size("__gone"), F.lit(0)))
    text = F.when(F.col("__gone").isNull(), F.col("text")).when(F.col("n_removed") == F.col("n_lines"), "").otherwise(kept)
    return both.withColumn("text", text).drop("__gone")


def op4_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document of the table with the lines it keeps."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_removed", F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256).alias("kept_sha256"), "text")


ORACLE = r"""
with l as (select doc_id, unnest(range(len(string_split(text, chr(10))))) as k, unnest(string_split(text, chr(10))) as line from documents where text is not null),
     w as (select *, trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g'), ' ') as norm from l),
     u as (select *, doc_id * 1000000 + k as place, len(string_split(norm, ' ')) as n from w where norm <> ''),
     s as (select norm, n, min(place) as place from u group by all),
     x as (select norm, place, case when n >= 8 then 0 else 1 end as kind, case when n >= 8 then string_split(norm, ' ') else string_split(norm, '') end as un from s where n >= 8 or length(norm) >= 8),
     i as (select *, unnest(range(1, len(un) + 1)) as i from x),
     v as (select norm, place, kind, i, list_concat(un[1:i - 1], un[i + 1:len(un)]) as rest from i),
     a as (select kind, i, rest, min(place) as p from v group by all),
     near as (select norm, p from v join a using (kind, i, rest) where p < place
       union all select v.norm, x.place from v join x on x.kind = v.kind and x.un = v.rest where x.place < v.place
       union all select x.norm, v.place from v join x on x.kind = v.kind and x.un = v.rest where v.place < x.place
       union all select norm, place from s),
     best as (select norm, min(p) as p from near group by norm),
     gone as (select u.doc_id, u.k from u join best using (norm) where u.place > best.p),
     g as (select doc_id, count(*) as n from gone group by doc_id),
     c as (select doc_id, count(*) as n from u group by doc_id),
     t as (select l.doc_id, string_agg(line, chr(10) order by l.k) as text from l anti join gone on l.doc_id = gone.doc_id and l.k = gone.k group by l.doc_id),
     o as (select d.doc_id, coalesce(c.n, 0)::int as n_lines, coalesce(g.n, 0)::int as n_removed, case when g.n is null then d.text when g.n = c.n then '' else t.text end as text
       from documents d left join c using (doc_id) left join g using (doc_id) left join t using (doc_id))
select doc_id, n_lines, n_removed, sha256(coalesce(text, '')) as kept_sha256, text from o
"""
