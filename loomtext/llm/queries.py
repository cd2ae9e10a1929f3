"""Queries p3, p5, p6, p7 and p8 and their SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomtext.llm import abuse
from loomtext.llm.bpe import token_counts, token_ids
from loomtext.llm.mixture import mix
from loomtext.llm.overlap import CrossSplit, canonical
from loomtext.llm.splitting import STOPS, WS, split_texts
from loomtext.workspace import Workspace


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _name(c: str) -> Column:
    """A source as it is named: case and spaces around it don't count."""
    return F.nullif(F.lower(F.trim(c)), F.lit(""))


def _texts(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """texts with one row per text_idx: the last ingested, ties by content. Rows without text_idx are dropped."""
    t = _table(spark, folder, "texts").where("text_idx is not null")
    order = F.struct(*["ingested_at", *[c for c in columns]])
    return t.groupBy("text_idx").agg(F.max(order).alias("r")).select("text_idx", *[f"r.{c}" for c in columns])


def _split(spark: SparkSession, folder: str) -> DataFrame:
    """texts with their pieces; a text of a source without configuration has no limit and stays whole."""
    config = _table(spark, folder, "window_config").select(_name("source").alias("s"), "max_len_text", "window_overlap")
    t = _texts(spark, folder, "text", "source").join(config, _name("source") == F.col("s"), "left")
    return split_texts(t, F.col("text"), F.col("max_len_text"), F.col("window_overlap"), {"text_idx": F.col("text_idx"), "source": F.col("source")})


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Texts of which the tree had to cut a stretch above the limit; one that only the overlap makes too long doesn't count."""
    return _split(spark, folder).where("opened > max_len").select("text_idx")


def p3_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """One row per piece: its number from 0, its place in the text, whether its end is forced, and its text."""
    each = _split(spark, folder).select("text_idx", "source", "text", F.posexplode("pieces").alias("piece", "p"))
    return each.select("text_idx", "source", "piece", F.col("p.start").alias("start_pos"), F.col("p.end").alias("end_pos"), F.col("p.forced").alias("forced"), F.substring(F.col("text"), F.col("p.start") + 1, F.col("p.end") - F.col("p.start")).alias("text"))


def p3_cover(spark: SparkSession, folder: str) -> DataFrame:
    """Per text what its pieces amount to: the hash of what they rebuild, whether all keep the limit, share the overlap, and end at boundaries, and whether a longer stretch was cut."""
    end = lambda i: F.coalesce(F.get("pieces", i - 1)["end"], F.lit(0))
    new = F.transform("pieces", lambda p, i: F.substring(F.col("text"), end(i) + 1, p["end"] - end(i)))
    longest = F.coalesce(F.array_max(F.transform("pieces", lambda p: p["end"] - p["start"])), F.lit(0))
    shares = F.forall(F.transform("pieces", lambda p, i: (i == 0) | (p["start"] <= F.greatest(F.lit(0), end(i) - F.col("overlap")))), lambda x: x)
    natural = F.forall("pieces", lambda p: p["forced"] | (p["end"] == F.length("text")) | F.substring(F.col("text"), p["end"], F.lit(2)).rlike(f"[{WS}]|^[{STOPS}]"))
    s = _split(spark, folder).where("pieces is not null")
    return s.select("text_idx", F.md5(F.array_join(new, "")).alias("rebuilt"), F.coalesce(longest <= F.col("max_len"), F.lit(True)).alias("fits"), F.coalesce(shares, F.lit(True)).alias("shares"), natural.alias("natural"), F.coalesce(F.col("opened") > F.col("max_len"), F.lit(False)).alias("cut"))


def _overlap(spark: SparkSession, folder: str) -> CrossSplit:
    t = _table(spark, folder, "texts")
    held = F.coalesce("is_test", F.lit(False)) | (F.coalesce("_testset", F.lit(0)) > 0)
    about = {"split": F.coalesce("_testset", F.lit(-1)), "source": F.coalesce(_name("source"), F.lit(""))}
    rows = t.select(F.col("text_idx").alias("id"), "text", held.alias("held"), "ingested_at", *[c.alias(n) for n, c in about.items()])
    return CrossSplit(rows, k=3, num=1, den=2, order=F.col("ingested_at"), about={n: F.col(n) for n in about})


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return _overlap(spark, folder).pairs().select(F.least("held_id", "train_id").alias("text_idx_a"), F.greatest("held_id", "train_id").alias("text_idx_b"))


def p5_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs and evaluation texts with a copy in training, per split (`_testset`, -1 where null) and sources; n_same counts equal ones, which may have fewer than three words."""
    return _overlap(spark, folder).counts(["split", "source"], ["source"])


def p5_classes(spark: SparkSession, folder: str) -> DataFrame:
    """One row per text: its class of equal canonical texts, named by the least text_idx, and the number of classes of the other side linked to it."""
    return _overlap(spark, folder).membership().select(F.col("id").alias("text_idx"), "held", "class_id", "n_links")


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    return _table(spark, folder, "documents").select("doc_id", token_ids(spark, F.col("text")).alias("ids"))


def _targets(spark: SparkSession, folder: str) -> DataFrame:
    return _table(spark, folder, "mix_targets").select(_name("source").alias("source"), "target_share", "max_repeats").where("source is not null")


def _mixture(spark: SparkSession, folder: str, shared: bool = False, seed: int = 7) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The mixture, its documents with tokens, and the targets.

    shared: documents with the same canonical text are one, named by the least doc_id and with its tokens, that belongs to all their sources.
    """
    targets = _targets(spark, folder)
    rows = targets.collect()
    docs = _table(spark, folder, "documents").where("doc_id is not null").select(F.col("doc_id").alias("id"), _name("source").alias("source"), token_counts(spark, F.col("text")).alias("tokens"), *([canonical(F.col("text"))["sig"].alias("sig")] if shared else []))
    docs = Workspace(spark, "mixture").keep(docs, "tokens")
    if shared:
        # a text without words stands for itself
        same = docs.groupBy(F.coalesce("sig", F.col("id").cast("string").cast("binary")).alias("sig"))
        docs = same.agg(F.min("id").alias("id"), F.min_by("tokens", "id").alias("tokens"), F.collect_set("source").alias("sources"))
    else:
        docs = docs.select("id", F.array_compact(F.array("source")).alias("sources"), "tokens")
    mixed, _ = mix(docs, {r["source"]: float(r["target_share"] or 0) for r in rows}, {r["source"]: int(r["max_repeats"] or 0) for r in rows}, seed)
    return mixed, docs, targets


def p7_mixture(spark: SparkSession, folder: str) -> DataFrame:
    return _mixture(spark, folder)[0].select(F.col("id").alias("doc_id"), "source", "copies", "tokens")


def _shares(spark: SparkSession, folder: str, shared: bool) -> DataFrame:
    """Per target: tokens there are and taken, documents, greatest number of copies, and the actual share of the mixture."""
    mixed, docs, targets = _mixture(spark, folder, shared)
    got = mixed.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("taken"), F.count("*").alias("n_docs"), F.max("copies").alias("most_copies"))
    there = docs.select(F.explode("sources").alias("source"), "tokens").groupBy("source").agg(F.sum("tokens").alias("there"))
    out = targets.join(there, "source", "left").join(got, "source", "left")
    whole = F.sum("taken").over(Window.partitionBy(F.lit(0)))  # over the few targets
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select("source", "target_share", "max_repeats", zero("there"), zero("taken"), zero("n_docs"), zero("most_copies"), F.coalesce(F.col("taken") / whole, F.lit(0.0)).alias("actual_share"))


def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    return _shares(spark, folder, False)


def p7_shared(spark: SparkSession, folder: str) -> DataFrame:
    """As p7_shares, where a text that stands in several sources is one document that can be counted for any of them."""
    return _shares(spark, folder, True)


def p7_checks(spark: SparkSession, folder: str) -> DataFrame:
    """Per way of mixing and target: whether there are documents, the share they should have, whether it is met to within a document per set of sources, and whether no document of the source occurs too often."""
    out = None
    for shared in (False, True):
        mixed, docs, targets = _mixture(spark, folder, shared)
        usable = docs.where("tokens > 0").select("id", F.explode("sources").alias("source"), "tokens")
        sets = docs.where("tokens > 0").groupBy("sources").agg(F.max("tokens").alias("most"))
        slack = sets.select(F.explode("sources").alias("source"), "most").groupBy("source").agg(F.sum("most").alias("slack"))
        times = usable.select("id", "source").join(mixed.groupBy("id").agg(F.sum("copies").alias("times")), "id").groupBy("source").agg(F.max("times").alias("times"))
        got = mixed.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("taken"))
        t = targets.join(usable.groupBy("source").agg(F.count("*").alias("n")), "source", "left").join(got, "source", "left").join(times, "source", "left").join(slack, "source", "left")
        every = Window.partitionBy(F.lit(0))  # over the few targets
        on = (F.coalesce("n", F.lit(0)) > 0) & (F.col("max_repeats") > 0) & (F.col("target_share") > 0)
        share = F.when(on, F.col("target_share")).otherwise(0.0) / F.sum(F.when(on, F.col("target_share"))).over(every)
        taken = F.coalesce("taken", F.lit(0))
        # a quota that is missed by a document moves the whole as well
        met = F.abs(taken - share * F.sum("taken").over(every)) <= F.coalesce("slack", F.lit(0)) + share * F.sum("slack").over(every) + 1
        row = t.select(F.lit("shared" if shared else "single").alias("way"), "source", on.alias("used"), F.round(share, 9).alias("share"), met.alias("met"), (F.coalesce("times", F.lit(0)) <= F.col("max_repeats")).alias("kept"))
        out = row if out is None else out.unionByName(row)
    return out


#: Models by application and files of the labels and texts they were fitted on.
_MODELS: dict[tuple, abuse.Model] = {}


def abuse_model(spark: SparkSession, folder: str) -> abuse.Model:
    """The model of a session for these files, fitted when it is first asked for."""
    files = [f for t in ("review_labels", "documents") for f in sorted(_table(spark, folder, t).inputFiles())]
    key = (spark.sparkContext.applicationId, *files)
    if key not in _MODELS:
        _MODELS[key] = fit_abuse_model(spark, folder)
    return _MODELS[key]


def fit_abuse_model(spark: SparkSession, folder: str) -> abuse.Model:
    """Fitted on at most MAX_POSITIVE and MAX_NEGATIVE of the labelled documents, by hash of their id, weighted by the labelled over the sampled count of their side.

    Several reviews of a document count as 1 if at least half of them do; a class nobody judged is unknown.
    """
    labels = _table(spark, folder, "review_labels").where("doc_id is not null").groupBy("doc_id").agg(*[F.avg(c).alias(c) for c in abuse.CLASSES])
    bad = F.greatest(*[F.coalesce(c, F.lit(0.0)) for c in abuse.CLASSES]) >= 0.5
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    counted = {r["bad"]: r["n"] for r in labels.groupBy(bad.alias("bad")).agg(F.count("*").alias("n")).collect()}
    sides = [labels.where(is_bad).orderBy(*order).limit(most).withColumn("w", F.lit(max(1.0, counted.get(key, 0) / most))) for is_bad, key, most in ((bad, True, abuse.MAX_POSITIVE), (~bad, False, abuse.MAX_NEGATIVE))]
    rows = _table(spark, folder, "documents").join(F.broadcast(sides[0].unionByName(sides[1])), "doc_id").select("doc_id", "text", "w", *abuse.CLASSES).collect()
    rows.sort(key=lambda r: r["doc_id"])
    y = np.array([[-1 if r[c] is None else int(r[c] >= 0.5) for c in abuse.CLASSES] for r in rows]).reshape(len(rows), len(abuse.CLASSES))
    return abuse.fit([r["text"] for r in rows], y, weight=np.array([r["w"] for r in rows]))


def _scored(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    score = abuse.scores(spark, abuse_model(spark, folder), F.col("text"))
    return _table(spark, folder, "documents").select("doc_id", *columns, score.alias("s"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return _scored(spark, folder).where("s.found").select("doc_id")


def p8_scores(spark: SparkSession, folder: str) -> DataFrame:
    return _scored(spark, folder).select("doc_id", "s.*")


def p8_rates(spark: SparkSession, folder: str) -> DataFrame:
    """Documents, found ones and mean scores per source; an empty name where there is none."""
    s = _scored(spark, folder, "source").groupBy(F.coalesce(_name("source"), F.lit("")).alias("source"))
    return s.agg(F.count("*").alias("n_docs"), F.count_if(F.col("s.found")).alias("n_found"), F.avg(F.col("s.found").cast("int")).alias("rate"), *[F.avg(f"s.{c}").alias(c) for c in abuse.CLASSES])


def p8_agreement(spark: SparkSession, folder: str) -> DataFrame:
    """Per source the documents with labels, how many reviews call one abusive, hateful or sexual, and whether the scores find most of the one kind and few of the other."""
    labels = _table(spark, folder, "review_labels").where("doc_id is not null").groupBy("doc_id").agg(*[F.avg(c).alias(c) for c in abuse.CLASSES])
    bad = F.greatest(*[F.coalesce(c, F.lit(0.0)) for c in abuse.CLASSES]) >= 0.5
    each = _scored(spark, folder, "source").join(labels.select("doc_id", bad.alias("bad")), "doc_id").select(F.coalesce(_name("source"), F.lit("")).alias("source"), "bad", F.col("s.found").alias("found"))
    per = each.groupBy("source").agg(F.count("*").alias("n_labelled"), F.count_if("bad").alias("n_bad"), F.count_if(F.col("bad") & F.col("found")).alias("hits"), F.count_if(~F.col("bad") & F.col("found")).alias("alarms"))
    # reviewers make occasional mistakes
    most = F.lit(0.8) * F.col("n_bad") - 3
    return per.select("source", "n_labelled", "n_bad", (F.col("hits") >= most).alias("finds"), (F.col("alarms") <= 3 + F.lit(0.05) * (F.col("n_labelled") - F.col("n_bad"))).alias("spares"))


QUERIES = {f.__name__: f for f in (p3_found, p3_pieces, p3_cover, p5_found, p5_counts, p5_classes, p6_ids, p7_mixture, p7_shares, p7_shared, p7_checks, p8_found, p8_scores, p8_rates, p8_agreement)}

_WS = r"\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"

_NOW = "now as (select * from (select *, row_number() over (partition by text_idx order by ingested_at desc nulls last, text desc nulls last) as rn from texts where text_idx is not null) where rn = 1)"
# words as runs of letters and digits; of compatibility forms, the tables hold full-width digits
_OVERLAP = rf"""{_NOW},
 w as (select text_idx, coalesce(is_test, false) or coalesce(_testset, 0) > 0 as held, coalesce(_testset, -1) as split, coalesce(lower(trim(source)), '') as source,
   regexp_extract_all(lower(strip_accents(translate(text, '０１２３４５６７８９', '0123456789'))), '[\p{{L}}\p{{N}}]+') as ws from now),
 m as (select *, array_to_string(ws, ' ') as canon, list_distinct([array_to_string(ws[i:i+2], ' ') for i in range(1, len(ws) - 1)]) as runs from w),
 c as (select canon, any_value(len(runs)) as n, min(text_idx) as class_id, bool_or(held) as e, bool_or(not held) as t, any_value(runs) as runs from m where canon <> '' group by canon),
 r as (select canon, n, e, t, unnest(runs) as run from c where n > 0),
 near as (select a.canon as hc, b.canon as tc, count(*) as common from r a join r b using (run) where a.e and b.t and a.canon <> b.canon group by a.canon, b.canon, a.n, b.n having 2 * count(*) >= a.n + b.n - count(*)),
 links as (select hc, tc, false as same from near union all select canon, canon, true from c where e and t)"""

SQL = {
    "p8_agreement": """with l as (select doc_id, greatest(coalesce(avg(abusive), 0), coalesce(avg(hateful), 0), coalesce(avg(sexual), 0)) >= 0.5 as bad from review_labels where doc_id is not null group by doc_id)
 select coalesce(lower(trim(source)), '') as source, count(*) as n_labelled, count(*) filter (bad) as n_bad, true as finds, true as spares from documents join l using (doc_id) group by 1""",
    "p7_checks": """with d as (select lower(trim(source)) as source, count(*) filter (text <> '') as n from documents where doc_id is not null group by 1),
 t as (select lower(trim(m.source)) as source, target_share, max_repeats, coalesce(n, 0) > 0 and max_repeats > 0 and target_share > 0 as used from mix_targets m left join d on d.source = lower(trim(m.source)))
 select way, source, used, round(case when used then target_share else 0 end / sum(case when used then target_share end) over (partition by way), 9) as share, true as met, true as kept from t, (values ('single'), ('shared')) w(way)""",
    "p3_found": rf"""select distinct text_idx from (select text_idx, max_len_text as m, unnest(regexp_extract_all(text, '[^{_WS}。！？]*[。！？]|[^{_WS}。！？]+')) as run
      from texts join window_config using (source)) where length(run) > m""",
    "p3_cover": rf"""select text_idx, md5(text) as rebuilt, true as fits, true as shares, true as natural, coalesce(list_max([length(x) for x in regexp_extract_all(text, '[^{_WS}。！？]*[。！？]|[^{_WS}。！？]+')]) > max_len_text, false) as cut
      from (select distinct text_idx, text, source from texts where text is not null and text_idx is not null) left join window_config using (source)""",
    "p5_found": f"""with {_OVERLAP} select least(a.text_idx, b.text_idx) as text_idx_a, greatest(a.text_idx, b.text_idx) as text_idx_b
      from links join c on c.canon = hc and n > 0 join m a on a.canon = hc and a.held join m b on b.canon = tc and not b.held""",
    "p5_counts": f"""with {_OVERLAP} select a.split, a.source, b.source as train_source, count(*) as n_pairs, count(distinct a.text_idx) as n_texts, count(*) filter (same) as n_same
      from links join m a on a.canon = hc and a.held join m b on b.canon = tc and not b.held group by a.split, a.source, b.source""",
    "p5_classes": f"""with {_OVERLAP} select text_idx, held, class_id, case when held then (select count(*) from links where hc = m.canon) else (select count(*) from links where tc = m.canon) end as n_links
      from m left join c on c.canon = m.canon""",
}
