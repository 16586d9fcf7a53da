"""Document fingerprints by spot signatures, with DataFrame functions only.

Words are runs of anything but white space and ASCII punctuation, in lower case. Wherever a common word (an anchor) stands
directly before a content word, that content word and the next two content words, whatever common words lie between, form a
chain; a spot signature is a hash of anchor and chain (16 hexadecimal digits of an MD5). A document's set is its distinct signatures. A
text with no complete chain has one signature, the hash of all its words (of the text itself, if there are none). The fingerprint is
the sorted set, joined by spaces; likeness is the Jaccard of two fingerprints' sets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

#: Common words of English, German, French and Spanish that anchor chains.
ANCHORS = (
    "a an and are as at be been but by for from had has have he her his i in is it its no not of on or she so that the their they this to was we were which who will with you "
    "aber als am an auch auf aus bei das dass dem den der des die ein eine einem einen einer es für hat ich im in ist mit nach nicht oder sich sie sind so um und von vor war wie wird zu zum zur "
    "au aux avec ce ces dans de des du elle en est et il ils je la le les leur mais ne nous on ou par pas plus pour qu que qui sa se ses son sont sur un une vous "
    "al como con de del el ella en entre era es esta este fue ha la las lo los más me mi muy no nos o para pero por que se ser si sin sobre su sus también te un una y ya"
).split()
CHAIN = 3
#: Documents of one run of neighbours, about. There are as many runs as that takes, up to RUNS; runs of more than 80 million documents
#: hold more, and a window over a long run spills.
RUN, RUNS = 4000, 20_000


def with_signatures(rows: DataFrame, text: str, name: str) -> DataFrame:
    """rows with the array column ``name``: the spot signatures of column ``text``. Steps stand in projections of their own, so that
    nothing is computed twice."""
    common = [F.lit(w) for w in sorted(set(ANCHORS))]
    keep = list(rows.columns)
    t = F.coalesce(F.col(text), F.lit(""))
    rows = rows.withColumn("__w", F.filter(F.split(F.lower(t), r"[\s\p{Punct}]+"), lambda w: w != ""))
    rows = rows.withColumn("__p", F.concat(F.array(F.lit("")), F.col("__w")))
    rows = rows.withColumn("__z", F.arrays_zip("__w", "__p"))
    rows = rows.withColumn("__c", F.filter("__z", lambda x: x["__w"].isNotNull() & ~x["__w"].isin(*common)))
    rows = rows.withColumn("__h", F.transform("__c", lambda x: F.struct(x["__w"].alias("w"), F.when(x["__p"].isin(*common), x["__p"]).alias("p"))))
    rows = rows.withColumn("__s1", F.slice("__h", F.lit(2), F.size("__h"))).withColumn("__s2", F.slice("__h", F.lit(3), F.size("__h")))
    rows = rows.withColumn("__r", F.filter(F.arrays_zip("__h", "__s1", "__s2"), lambda x: x["__h"]["p"].isNotNull() & x["__s2"].isNotNull()))
    chain = F.transform("__r", lambda x: _short(F.concat_ws(" ", x["__h"]["p"], x["__h"]["w"], x["__s1"]["w"], x["__s2"]["w"])))
    rows = rows.withColumn("__x", F.array_sort(F.array_distinct(chain)))
    whole = F.when(F.size("__w") > 0, _short(F.concat(F.lit("words "), F.array_join("__w", " ")))).otherwise(_short(F.concat(F.lit("text "), t)))
    return rows.select(*keep, F.when(F.size("__x") > 0, F.col("__x")).otherwise(F.array(whole)).alias(name))


def _short(text: Column) -> Column:
    return F.left(F.md5(text.cast("binary")), F.lit(16))


def fingerprint(signs: Column) -> Column:
    """The sorted set as text, so that likeness follows from two fingerprints."""
    return F.array_join(signs, " ")


def likeness(a: str, b: str) -> Column:
    """Jaccard of two distinct arrays."""
    both = F.size(F.array_intersect(a, b))
    return both / (F.size(a) + F.size(b) - both)


def near_pairs(docs: DataFrame, share: float = 0.75) -> DataFrame:
    """(a, b, likeness), a < b, for documents (doc_id, text) of different sets whose likeness is share or more.

    Equal sets are one class, kept by its smallest doc_id. Sets are partitioned by length so that a set meets only its own and
    the next longer partition; there it is compared through its rarest signatures (its prefix), and pairs whose lengths or
    positions cannot reach the share are pruned before their sets are read. Rows without doc_id take no part.
    """
    rows = with_signatures(docs.where("doc_id is not null").select("doc_id", "text"), "text", "signs")
    sets = saved(rows.groupBy("signs").agg(F.min("doc_id").alias("id")).withColumn("n", F.size("signs")), "spot-sets")
    part = F.floor(F.log(F.col("n")) / F.log(F.lit(1 / share))).cast("int")
    each = sets.select("id", "n", part.alias("part"), F.explode("signs").alias("s"))
    df = each.groupBy("s").agg(F.count("*").alias("f"))
    order = F.row_number().over(Window.partitionBy("id").orderBy("f", "s"))
    need = F.ceil(F.col("n") * share - 1e-9)
    prefix = each.join(df, "s").withColumn("i", order).where((F.col("f") > 1) & (F.col("i") <= F.col("n") - need + 1)).select("id", "n", "part", "s", "i")
    prefix = saved(prefix, "spot-prefixes")
    a = prefix.alias("a")
    b = prefix.withColumn("to", F.explode(F.array(F.col("part"), F.col("part") + 1))).alias("b")  # itself, and as the shorter one
    fits = f"a.s = b.s and a.part = b.to and (b.n < a.n or (b.n = a.n and b.id < a.id)) and b.n >= {share} * a.n - 1e-9"
    reach = f"least(a.n - a.i, b.n - b.i) + 1 >= {share} / (1 + {share}) * (a.n + b.n) - 1e-9"
    pairs = a.join(b, F.expr(f"{fits} and {reach}")).select(F.col("a.id").alias("x"), F.col("b.id").alias("y")).distinct()
    left, right = sets.select(F.col("id").alias("x"), F.col("signs").alias("p")), sets.select(F.col("id").alias("y"), F.col("signs").alias("q"))
    out = pairs.join(left, "x").join(right, "y").withColumn("likeness", likeness("p", "q")).where(F.col("likeness") >= share)
    return out.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "likeness")


def _above(x: Column, cuts: list) -> Column:
    """How many of the sorted cuts are x or more, by binary search."""
    if not cuts:
        return F.lit(0)
    table, n = F.array(*[F.lit(c) for c in cuts]), len(cuts)
    steps = F.array(*[F.lit(1 << k) for k in range(n.bit_length() - 1, -1, -1)])
    return F.lit(n) - F.aggregate(steps, F.lit(0), lambda at, s: F.when((at + s <= n) & (F.try_element_at(table, at + s) < x), at + s).otherwise(at))


def with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, text, next_text) of docs (doc_id, text): next is the next row in descending doc_id, after the last the first.

    Rows are dealt into runs of neighbouring ids at percentiles of doc_id, so a window never holds more than about RUN rows of
    different ids. The first row of each run is found from ids and hashes alone and is copied into the run before it, as a guest
    that only serves as the next row of that run's last one. So texts are shuffled once.
    """
    stats = docs.agg(F.count("*").alias("n"), F.count("doc_id").alias("ids")).first()
    runs = max(1, min(RUNS, -(-stats.n // RUN)))
    cuts: list = []
    if stats.ids and runs > 1:
        share = [i / runs for i in range(1, runs)]
        cuts = sorted(set(docs.select(F.percentile_approx("doc_id", share, max(10_000, 10 * runs))).first()[0]))
    run = _above(F.col("doc_id"), cuts)
    rows = docs.select("doc_id", "text", F.when(F.col("doc_id").isNull(), F.lit(len(cuts) + 1)).otherwise(run).alias("run"), F.xxhash64("text").alias("h"))
    firsts = {r.run: r.f for r in rows.groupBy("run").agg(F.max(F.struct("doc_id", F.bitwise_not("h").alias("g"))).alias("f")).collect()}
    ids = sorted(firsts)
    table = [(r, ids[i - 1], firsts[r].doc_id, firsts[r].g) for i, r in enumerate(ids)]
    openings = docs.sparkSession.createDataFrame(table, f"run int, before int, first {dict(docs.dtypes)['doc_id']}, g long")
    rows = rows.join(F.broadcast(openings), "run")
    opens = F.col("doc_id").eqNullSafe(F.col("first")) & (F.bitwise_not("h") == F.col("g"))
    places = F.array(F.struct(F.col("run").alias("run"), F.lit(False).alias("guest")))
    places = F.when(opens, F.concat(places, F.array(F.struct(F.col("before").alias("run"), F.lit(True).alias("guest"))))).otherwise(places)
    rows = rows.select("doc_id", "text", "h", F.explode(places).alias("p")).select("doc_id", "text", "h", "p.run", "p.guest")
    order = Window.partitionBy("run").orderBy("guest", F.desc_nulls_last("doc_id"), "h", "text")
    return rows.withColumn("next_text", F.lead("text").over(order)).where("not guest").select("doc_id", "text", "next_text")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for every row of docs (doc_id, text).

    Null text is empty. Rows of one doc_id, and rows without one (they come last), follow each other by the hashes of their texts.
    A single row is its own next document. An empty table gives an empty result.
    """
    both = with_next(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))).withColumn("n_chars", F.char_length("text").cast("long"))
    third = F.floor(F.col("n_chars") / 3).cast("int")
    both = both.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - third), F.substring("next_text", F.lit(1), third)))
    both = with_signatures(both, "text", "signs").drop("text")
    both = with_signatures(both, "next_text", "next_signs").drop("next_text")
    both = with_signatures(both, "edited", "edited_signs")
    return both.select(
        "doc_id", "n_chars", F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"), fingerprint(F.col("signs")).alias("fingerprint"),
        fingerprint(F.col("edited_signs")).alias("edited_fingerprint"), likeness("signs", "edited_signs").alias("near_edited"), likeness("signs", "next_signs").alias("near_next"),
    )


def op3_spot_signatures(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


_ANCHORS_SQL = ", ".join(f"'{w}'" for w in sorted(set(ANCHORS)))


def _signatures_sql(texts: str, name: str) -> str:
    """Common table expressions that end in ``name`` (doc_id, signs), for a table (doc_id, t)."""
    return f"""{name}w as (select doc_id, t, list_filter(regexp_split_to_array(lower(t), '[\\x09-\\x0D \\x21-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7E]+'), lambda x: x <> '') as ws from {texts}),
     {name}e as (select doc_id, unnest(ws) as w, unnest(range(len(ws))) as i, unnest(list_concat([''], ws[1:len(ws) - 1])) as p from {name}w),
     {name}c as (select doc_id, w, p, i, lead(w, 1) over (partition by doc_id order by i) as w1, lead(w, 2) over (partition by doc_id order by i) as w2 from {name}e where w not in ({_ANCHORS_SQL})),
     {name}s as (select doc_id, list_sort(list(distinct md5(p || ' ' || w || ' ' || w1 || ' ' || w2)[1:16])) as signs from {name}c where p in ({_ANCHORS_SQL}) and w2 is not null group by doc_id),
     {name} as (select w.doc_id, coalesce(signs, [md5(case when len(ws) > 0 then 'words ' || array_to_string(ws, ' ') else 'text ' || t end)[1:16]]) as signs from {name}w w left join {name}s using (doc_id))"""


def _likeness_sql(a: str, b: str) -> str:
    return f"len(list_intersect({a}, {b}))::double / (len({a}) + len({b}) - len(list_intersect({a}, {b})))"


ORACLE = f"""
with d as (select doc_id, coalesce(text, '') as t from documents),
     n as (select *, coalesce(lead(doc_id) over (order by doc_id desc), first(doc_id) over (order by doc_id desc)) as next from d),
     e as (select n.doc_id, n.next, length(n.t) as n_chars, n.t[1:length(n.t) - length(n.t) // 3] || m.t[1:length(n.t) // 3] as t from n join d m on m.doc_id = n.next),
     {_signatures_sql("d", "own")}, {_signatures_sql("e", "changed")}
select e.doc_id, n_chars::bigint as n_chars, sha256(e.t) as edited_sha256, array_to_string(o.signs, ' ') as fingerprint, array_to_string(c.signs, ' ') as edited_fingerprint,
       {_likeness_sql("o.signs", "c.signs")} as near_edited, {_likeness_sql("o.signs", "x.signs")} as near_next
from e join own o on o.doc_id = e.doc_id join changed c on c.doc_id = e.doc_id join own x on x.doc_id = e.next
"""
