"""The pN_ queries over the tables of a data directory, and SQL for those that have any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.llm import budget, langid, mixing, neighbours, overlap, packing, pieces, quality, sampling
from quernstone.llm.labels import code_of
from quernstone.llm.tokens import BytePairs, Pieces, count_tokens
from quernstone.llm.queries_sql import SQL
from quernstone.plans.staging import checked_broadcast, spread
from quernstone.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
_ALL: dict[str, Query] = {}


def query(f: Query) -> Query:
    _ALL[f.__name__] = f
    return f


# ---- problem 1: nearest vectors


def _vectors(spark: SparkSession, d: str) -> list[tuple[str, DataFrame]]:
    return [("embeds", table(spark, d, "doc_embeds")), ("encode", table(spark, d, "doc_encodes"))]


@query
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of documents of which one is among the other's 10 nearest, with a cosine of 0.90 or more."""
    each = []
    for field, df in _vectors(spark, d):
        near = neighbours.nearest(df, "docid", field, k=10, least=0.90, tables=8)
        each.append(near.select(F.lit(field).alias("field"), F.least("id", "near_id").alias("docid_a"), F.greatest("id", "near_id").alias("docid_b")))
    return each[0].unionByName(each[1]).distinct()


@query
def p1_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The 10 nearest, however far, of every document whose number is divisible by 20."""
    each = [neighbours.nearest(df, "docid", field, k=10, tables=6, hashes=1, probes=8, asking="cast(regexp_extract(id, '([0-9]+)$', 1) as bigint) % 20 = 0").select(F.lit(field).alias("field"), "id", "near_id", "cosine", "rank") for field, df in _vectors(spark, d)]
    return each[0].unionByName(each[1])


# ---- problem 2: languages


def _labelled(spark: SparkSession, d: str) -> tuple[DataFrame, langid.KneserNey]:
    """corpus_df and train as ``tbl, rec_id, label, text``, and models fitted on all of them."""
    codes = table(spark, d, "languages")
    corpus = table(spark, d, "corpus_df").select(F.lit("corpus_df").alias("tbl"), F.col("docid").alias("rec_id"), code_of(F.col("lang"), codes).alias("label"), "text")
    train = table(spark, d, "train").select(F.lit("train").alias("tbl"), F.col("query_id").cast("string").alias("rec_id"), code_of(F.col("lang"), codes).alias("label"), F.col("query").alias("text"))
    records = corpus.unionByName(train)
    return records, langid.fit_records(records, ("tbl", "rec_id"))


@query
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Records whose label is missing, wrong or hides a mix: one row a language of the text."""
    records, model = _labelled(spark, d)
    found = langid.relabel(records, model, ("tbl",))
    return found.where(F.col("problem").isNotNull()).select("tbl", "rec_id", F.explode("langs").alias("found_lang")).distinct()


@query
def p2_languages(spark: SparkSession, d: str) -> DataFrame:
    """Every record with a text: its languages with shares and confidence."""
    records, model = _labelled(spark, d)
    found = langid.relabel(records, model, ("tbl",)).dropDuplicates(["tbl", "rec_id"])
    each = F.explode(F.arrays_zip(F.col("langs").alias("lang"), F.col("shares").alias("share"), F.col("confidences").alias("confidence")))
    return found.select("tbl", "rec_id", "label", "problem", each.alias("x")).select("tbl", "rec_id", "label", "problem", "x.lang", F.round("x.share", 6).alias("share"), F.round("x.confidence", 6).alias("confidence"))


@query
def p2_segments(spark: SparkSession, d: str) -> DataFrame:
    """Every stretch of one language in corpus_df and train, with its language, words and confidence."""
    records, model = _labelled(spark, d)
    found = langid.segments(records, model, keep=("tbl",))
    return found.select("tbl", "rec_id", "seg_no", "lang", "n_words", F.round("confidence", 6).alias("confidence"), F.length("segment").alias("n_chars")).dropDuplicates(["tbl", "rec_id", "seg_no"])


# ---- problem 3: oversized items


@query
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Items above the window, and whether their boundaries suffice."""
    cut = pieces.split_items(table(spark, d, "token_dataset"), Pieces.of(table(spark, d, "vocab")))
    return cut.where("cut_kind <> 'whole'").select("item_id", "cut_kind").distinct()


@query
def p3_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Every item's pieces."""
    cut = pieces.split_items(table(spark, d, "token_dataset"), Pieces.of(table(spark, d, "vocab")))
    return cut.dropDuplicates(["item_id", "piece_no"])


# ---- problem 4: samples in target proportions


def _asked_once(spark: SparkSession, d: str) -> DataFrame:
    codes = table(spark, d, "languages")
    domains = table(spark, d, "sources").groupBy("source").agg(F.min("domain").alias("attribute"))
    asked = table(spark, d, "train").where(F.col("query").rlike(r"(?U)\S"))
    records = asked.select(F.col("query_id").alias("rec_id"), code_of(F.col("lang"), codes).alias("category"), "source").join(domains, "source", "left")
    return records.groupBy("rec_id").agg(F.min(F.struct("category", "attribute")).alias("x")).select("rec_id", "x.*")


def _drawn(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    targets = table(spark, d, "sample_targets").withColumnRenamed("lang", "category")
    return sampling.stratified(_asked_once(spark, d), targets)


@query
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Targets that train cannot meet."""
    return _drawn(spark, d)[1].where("unmet").select("plan_id", F.col("category").alias("lang")).distinct()


@query
def p4_report(spark: SparkSession, d: str) -> DataFrame:
    """Every target with what there is and what was drawn."""
    return _drawn(spark, d)[1].withColumnRenamed("category", "lang")


@query
def p4_sample(spark: SparkSession, d: str) -> DataFrame:
    """The drawn queries of every plan."""
    return _drawn(spark, d)[0].select("plan_id", F.col("rec_id").alias("query_id"), F.col("category").alias("lang"), F.col("attribute").alias("domain"))


@query
def p4_shares(spark: SparkSession, d: str) -> DataFrame:
    """Of every plan and language the rows of each domain, and whether the sample holds their proportional share but for one row."""
    records, domain = _asked_once(spark, d), "attribute"
    sample, report = _drawn(spark, d)
    cells = records.groupBy("category", domain).agg(F.count("*").alias("n_rows"))
    drawn = sample.groupBy("plan_id", "category", domain).agg(F.count("*").alias("n"), F.countDistinct("rec_id").alias("n_ids"))
    every = report.select("plan_id", "category", "n_available", "n_drawn").join(cells, "category")
    both = [every[c].eqNullSafe(drawn[c]) for c in ("plan_id", "category", domain)]
    share = F.col("n_drawn") * F.col("n_rows") / F.col("n_available")
    fair = (F.abs(F.coalesce("n", F.lit(0)) - share) < 1) & (F.coalesce("n", F.lit(0)) == F.coalesce("n_ids", F.lit(0)))
    return every.join(drawn, both, "left").select(every["plan_id"], every["category"].alias("lang"), every[domain].alias("domain"), "n_rows", fair.alias("fair"))


# ---- problem 5: overlaps across splits


def _splits(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    code = code_of(F.col("lang"), table(spark, d, "languages")).alias("lang")
    train = table(spark, d, "train").select("query_id", "query", "source", code)
    dev, test = (table(spark, d, x).select("query_id", "query", "source", code, F.lit(x).alias("split")) for x in ("dev", "test"))
    return train, dev.unionByName(test)


@query
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of a train query and a dev or test query that ask the same."""
    pairs = overlap.expand(*overlap.same_questions(*_splits(spark, d)))
    return pairs.select(F.least("train_id", "eval_id").alias("query_id_a"), F.greatest("train_id", "eval_id").alias("query_id_b")).where("query_id_a <> query_id_b").distinct()


@query
def p5_report(spark: SparkSession, d: str) -> DataFrame:
    """Overlaps with training counted per split and source."""
    return overlap.report(*overlap.same_questions(*_splits(spark, d)))


# ---- problem 6: token budgets


def _budget(spark: SparkSession, d: str) -> DataFrame:
    code = code_of(F.col("lang"), table(spark, d, "languages"))
    counts = budget.item_tokens(table(spark, d, "token_dataset"), table(spark, d, "corpus_df"), Pieces.of(table(spark, d, "vocab")), code)
    return budget.totals(counts, table(spark, d, "sources"))


@query
def p6_totals(spark: SparkSession, d: str) -> DataFrame:
    """Items and tokens of each source, domain and language."""
    return _budget(spark, d)


@query
def p6_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Items and tokens of each source, of each language, of each domain and of all."""
    return budget.rollup(_budget(spark, d))


# ---- problems 7 and 8: containers and mixes


def _sizes(documents: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    return count_tokens(documents, "doc_id", "text", BytePairs, keep)


@query
def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents larger than a container, which are split."""
    packed = packing.pack(_sizes(spread(table(spark, d, "documents").select("doc_id", "text"))))
    return packed.groupBy("doc_id").agg(F.countDistinct("container").alias("n")).where("n > 1").select("doc_id")


@query
def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    """Every document's container, or containers."""
    return packing.pack(_sizes(spread(table(spark, d, "documents").select("doc_id", "text"))))


@query
def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    """How full the containers are."""
    return packing.fill(packing.pack(_sizes(spread(table(spark, d, "documents").select("doc_id", "text")))))


@query
def p7_rules(spark: SparkSession, d: str) -> DataFrame:
    """Of every document whether it lies whole in one container, or in full ones and a rest, none of them above the capacity."""
    sizes = _sizes(spread(table(spark, d, "documents").select("doc_id", "text")))
    packed = packing.pack(sizes)
    loads = packed.groupBy("container").agg(F.sum("n_tokens").alias("load"))
    parts = packed.join(loads, "container").groupBy("doc_id").agg(F.sum("n_tokens").alias("placed"), F.count("*").alias("n"), F.countDistinct("part").alias("parts"), F.max("load").alias("load"))
    kept = (F.col("placed") == F.col("n_tokens")) & (F.col("n") == F.col("parts")) & (F.col("n") == F.greatest(F.ceil(F.col("n_tokens") / packing.CAPACITY), F.lit(1))) & (F.col("load") <= packing.CAPACITY)
    return sizes.where("n_tokens is not null").join(parts, "doc_id", "left").select("doc_id", F.coalesce(kept, F.lit(False)).alias("kept"))


def _mixed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    targets = table(spark, d, "mix_targets")
    named = targets.select("source").distinct()
    documents = table(spark, d, "documents").join(checked_broadcast(named, mixing.MOST_BROADCAST), "source", "left_semi")
    return mixing.mix(_sizes(documents, ("source",)), targets)


@query
def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Targets that their source can't reach with all its uses."""
    return _mixed(spark, d)[1].where("short").select("mix_id", "source").distinct()


@query
def p8_report(spark: SparkSession, d: str) -> DataFrame:
    """Target and actual share of every source in every mix."""
    made = _mixed(spark, d)[1]
    return made.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in made.dtypes])


@query
def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    """The documents of every mix and how often each is used."""
    return _mixed(spark, d)[0]


@query
def p8_rules(spark: SparkSession, d: str) -> DataFrame:
    """Of every target whether the mix keeps it: uses up to ``max_repeats``, tokens as reported, no more than the target rounded up, no use left where it is short."""
    used, report = _mixed(spark, d)
    sums = used.groupBy("mix_id", "source").agg(F.max("n_uses").alias("most"), F.sum(F.col("n_tokens") * F.col("n_uses")).alias("tokens"), F.count("*").alias("n"), F.countDistinct("doc_id").alias("ids"))
    kept = F.coalesce((F.col("most") <= F.col("max_repeats")) & (F.col("tokens") == F.col("actual_tokens")) & (F.col("n") == F.col("ids")), F.col("actual_tokens") == 0)
    kept &= (F.col("actual_tokens") <= F.ceil("target_tokens")) & (~F.col("short") | (F.col("actual_tokens") == F.col("available_tokens") * F.col("max_repeats")))
    return report.join(sums, ["mix_id", "source"], "left").select("mix_id", "source", F.col("weight_pct").cast("int").alias("weight_pct"), "max_repeats", kept.alias("kept"))


# ---- problem 9: text statistics


def _quality(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "documents")
    return quality.statistics(documents, quality.fit_profiles(documents, table(spark, d, "languages")))


@query
def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that are mainly a list, a table or junk."""
    return _quality(spark, d).where("kind <> 'prose'").select("doc_id", "kind").distinct()


@query
def p9_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Every document's statistics and kind."""
    found = _quality(spark, d)
    return found.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in found.dtypes])


@query
def p9_counts(spark: SparkSession, d: str) -> DataFrame:
    """The basic counts of every document that isn't blank."""
    documents = table(spark, d, "documents")
    measured = quality.measure(documents, quality.Profiles({}, {}, set())).where("shares is not null")
    return measured.select("doc_id", "n_words", F.round("mean_word_length", 6).alias("mean_word_length"), F.round("end_punctuation_share", 6).alias("end_punctuation_share"))


def queries() -> dict[str, Query]:
    return dict(_ALL)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
