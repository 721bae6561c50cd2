"""Scanners that need the whole dataset: one aggregation each, of which small results are joined back.

Text is grouped by its md5, so that shuffles carry 16 bytes instead of questions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dqaudit.functions.images import image_key
from dqaudit.functions.text import percent, py_repr, upper_first
from dqaudit.model import FieldMap, Scanner, findings

MAJORITY, DOMINANT, BINARY = 0.8, 0.85, 0.5


def _say(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _whole(df: DataFrame) -> DataFrame:
    """A dataset-level row."""
    return df.withColumns({"sample_index": F.lit(-1).cast("bigint"), "sample_id": F.lit(None).cast("string")})


# --- distribution -------------------------------------------------------------------------------------------------------------


def top_answers(df: DataFrame) -> DataFrame:
    """answer, count, first_index of each different non-empty answer in lower case."""
    return df.where("a_norm <> ''").groupBy(F.col("a_norm").alias("answer")).agg(F.count("*").alias("count"), F.min("sample_index").alias("first_index"))


def answer_distribution_row(df: DataFrame, threshold: float = DOMINANT, top: int = 10) -> DataFrame:
    """One row if the commonest answer makes up the threshold's share: most_common_answer, most_common_count, total, fraction, top_10."""
    counts = top_answers(df)
    best = F.slice(F.sort_array(F.collect_list(F.struct((-F.col("count")).alias("n"), "first_index", "answer"))), 1, top)
    ranked = counts.withColumn("__bucket", F.pmod(F.xxhash64("answer"), F.lit(64)))
    at = W.partitionBy("__bucket").orderBy(F.desc("count"), "first_index")
    head = ranked.withColumn("__r", F.row_number().over(at)).where(F.col("__r") <= top)  # at most 64 x top rows are gathered
    out = head.agg(best.alias("best")).crossJoin(counts.agg(F.sum("count").alias("total"))).where("total > 0")
    out = out.withColumns({"most_common_answer": F.col("best")[0]["answer"], "most_common_count": -F.col("best")[0]["n"], "top_10": F.transform("best", lambda b: F.struct(b.answer.alias("answer"), (-b.n).alias("count")))})
    return out.withColumn("fraction", F.col("most_common_count") / F.col("total")).where(F.col("fraction") >= threshold).drop("best")


def _distribution(df: DataFrame, fields: FieldMap) -> DataFrame:
    r = _whole(answer_distribution_row(df))
    why = _say(F.col("most_common_count"), " of ", F.col("total"), " answers (", percent(F.col("most_common_count"), F.col("total")), ") are ", py_repr("most_common_answer"), ": a constant guess scores as much.")
    meta = {"most_common_answer": F.col("most_common_answer"), "most_common_count": F.col("most_common_count"), "total": F.col("total"), "fraction": F.round("fraction", 4), "top_10": F.col("top_10")}
    return findings(r, "answer_distribution", "high", "distribution", why, meta)


def binary_ratio_row(df: DataFrame, threshold: float = BINARY) -> DataFrame:
    """One row if more than the threshold's share of the non-empty answers are yes or no."""
    yes, no = F.count_if(F.col("a_norm") == "yes"), F.count_if(F.col("a_norm") == "no")
    r = df.agg(F.count_if(F.col("a_norm") != "").alias("total"), yes.alias("yes_count"), no.alias("no_count")).withColumn("binary_count", F.col("yes_count") + F.col("no_count"))
    r = r.where("total > 0").withColumn("fraction", F.col("binary_count") / F.col("total")).where(F.col("fraction") > threshold)
    return r.withColumn("majority", F.when(F.col("yes_count") >= F.col("no_count"), "yes").otherwise("no")).withColumn("naive_majority_score", F.greatest("yes_count", "no_count") / F.col("total"))


def _binary(df: DataFrame, fields: FieldMap) -> DataFrame:
    r = _whole(binary_ratio_row(df))
    why = _say(F.col("binary_count"), " of ", F.col("total"), " answers (", percent(F.col("binary_count"), F.col("total")), ") are yes or no; answering '", F.col("majority"), "' always is right in ", percent(F.greatest("yes_count", "no_count"), F.col("total")), " of all.")
    meta = {k: F.col(k) for k in ("binary_count", "total", "fraction", "yes_count", "no_count")} | {"naive_majority_score": F.round("naive_majority_score", 4)}
    return findings(r, "binary_question_ratio", "low", "distribution", why, meta | {"fraction": F.round("fraction", 4)})


# --- duplicates ---------------------------------------------------------------------------------------------------------------


def question_groups(df: DataFrame) -> DataFrame:
    """__q (md5 of the normalised question), duplicate_count, answers_agree, first_index of the questions asked more than once."""
    rows = df.select(F.unhex(F.md5("q_norm")).alias("__q"), F.md5("a_norm").alias("__a"), "sample_index")
    g = rows.groupBy("__q").agg(F.count("*").alias("duplicate_count"), (F.min("__a") == F.max("__a")).alias("answers_agree"), F.min("sample_index").alias("first_index"))
    return g.where("duplicate_count > 1")


def indices(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.array_sort(F.collect_list("sample_index")).alias("duplicate_indices"))


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Records whose normalised question (an empty one too) is asked more than once."""
    keyed = df.withColumn("__q", F.unhex(F.md5("q_norm")))
    return keyed.join(question_groups(df), "__q").withColumn("severity", F.when(F.col("answers_agree"), "high").otherwise("low"))


def duplicate_image_rows(df: DataFrame, image: str) -> DataFrame:
    """kind exact: question and image (a missing one too) stand together more than once; kind question_reuse: the question is asked about
    several images.  A record may have both."""
    keyed = df.withColumn("__q", F.unhex(F.md5("q_norm"))).withColumn("__i", F.md5(image_key(F.col(f"`{image}`"), df.schema[image].dataType)))
    slim = keyed.select("__q", "__i", F.md5("a_norm").alias("__a"), "sample_index")
    per = slim.groupBy("__q", "__i").agg(F.count("*").alias("n"), F.min("__a").alias("low"), F.max("__a").alias("high"), F.min("sample_index").alias("first"))
    exact = per.where("n > 1").select("__q", "__i", F.col("n").alias("duplicate_count"), F.col("first").alias("image_first"))
    reuse = per.groupBy("__q").agg(F.sum("n").alias("duplicate_count"), (F.min("low") == F.max("high")).alias("answers_agree"), F.count("__i").alias("images"), F.min("first").alias("first_index")).where("duplicate_count > 1")
    q_first = reuse.select("__q", "first_index")
    a = keyed.alias("k").join(exact.alias("e"), (F.col("k.__q") == F.col("e.__q")) & F.col("k.__i").eqNullSafe(F.col("e.__i"))).select("k.*", "e.duplicate_count", "e.image_first").join(q_first, "__q")
    a = a.withColumns({"duplicate_type": F.lit("exact"), "answers_agree": F.lit(None).cast("boolean"), "severity": F.lit("high"), "phase": F.lit(0)})
    b = keyed.join(reuse.where("images >= 2").drop("images"), "__q").withColumns({"image_first": F.col("first_index"), "duplicate_type": F.lit("question_reuse"), "phase": F.lit(1)})
    b = b.withColumn("severity", F.when(F.col("answers_agree"), "medium").otherwise("low"))
    return a.unionByName(b)


def _duplicates(df: DataFrame, fields: FieldMap) -> DataFrame:
    """A finding names its group by the key that all its members have; the list of members is one row of indices() and is put into each finding
    only where findings are saved (see report.save), as n members with n indices each would grow with the square of a group."""
    if fields.image is None:
        r = duplicate_rows(df)
        why = _say("The question is asked ", F.col("duplicate_count"), " times ", F.when(F.col("answers_agree"), "with the same answer").otherwise("with different answers"), ".")
        meta = {"question": F.col("q_norm"), "duplicate_group": F.hex("__q"), "duplicate_count": F.col("duplicate_count"), "answers_agree": F.col("answers_agree")}
        return findings(r, "duplicate_questions", F.col("severity"), "question_quality", why, meta, first=F.col("first_index"))
    r = duplicate_image_rows(df, fields.image)
    group = F.concat(F.hex("__q"), F.when(F.col("phase") == 0, F.concat(F.lit("-"), F.coalesce("__i", F.lit("")))).otherwise(F.lit("")))
    why = F.when(F.col("phase") == 0, _say("Question and image stand together ", F.col("duplicate_count"), " times.")).when(F.col("answers_agree"), _say("The question is asked about different images ", F.col("duplicate_count"), " times with one answer, ", py_repr("a_norm"), ": it can be answered without the image.")).otherwise(_say("The question is asked about different images ", F.col("duplicate_count"), " times with different answers."))
    meta = {"question": F.col("q_norm"), "duplicate_group": group, "duplicate_count": F.col("duplicate_count"), "duplicate_type": F.col("duplicate_type"), "answers_agree": F.col("answers_agree")}
    return findings(r, "duplicate_questions", F.col("severity"), "question_quality", why, meta, first=F.col("first_index"), within=F.col("phase"))


# --- format -------------------------------------------------------------------------------------------------------------------


def format_stats(df: DataFrame) -> DataFrame:
    """One row of counts over the non-empty answers."""
    a, wc = F.col("a"), F.col("a_words").cast("decimal(38,0)")
    own = df.where("a <> ''")
    return own.agg(F.count("*").alias("n"), F.count_if(a == F.lower(a)).alias("lower_n"), F.count_if(upper_first(a)).alias("upper_n"), F.count_if(a.rlike(r"(?s)[.!?]\z")).alias("punct_n"), F.sum(wc).alias("s"), F.sum(wc * wc).cast("decimal(38,0)").alias("qq"))


def format_rows(df: DataFrame) -> DataFrame:
    """issue: capitalisation, trailing_punctuation or length_outlier; a record may have each."""
    stats = format_stats(df).where("n >= 2")
    r = df.where("a <> ''").crossJoin(F.broadcast(stats))
    a, n = F.col("a"), F.col("n")
    lower, upper = F.col("lower_n") / n >= MAJORITY, F.col("upper_n") / n >= MAJORITY
    caps = F.when(lower & (a != F.lower(a)), "lower").when(upper & ~upper_first(a), "upper")
    dotted = a.rlike(r"(?s)[.!?]\z") & ~a.endswith("etc.")
    punct = F.when((F.col("punct_n") / n >= MAJORITY) & ~dotted, "with").when(((n - F.col("punct_n")) / n >= MAJORITY) & dotted, "without")
    dn, s, qq, wc = n.cast("decimal(38,0)"), F.col("s").cast("decimal(38,0)"), F.col("qq"), F.col("a_words").cast("decimal(38,0)")
    d = (lambda x: x.cast("decimal(38,0)"))
    over = d(dn * wc) - s
    outlier = (over > 0) & (d(d(over * over) * (n - 1).cast("decimal(38,0)")) > d(F.lit(9).cast("decimal(38,0)") * d(dn * d(d(dn * qq) - d(s * s)))))
    issue = F.array(
        F.when(caps.isNotNull(), F.struct(F.lit("capitalisation").alias("issue"), caps.alias("how"), F.lit(0).alias("phase"))),
        F.when(punct.isNotNull(), F.struct(F.lit("trailing_punctuation").alias("issue"), punct.alias("how"), F.lit(1).alias("phase"))),
        F.when(outlier, F.struct(F.lit("length_outlier").alias("issue"), F.lit("long").alias("how"), F.lit(2).alias("phase"))),
    )
    return r.withColumn("__x", F.explode(F.filter(issue, lambda x: x.isNotNull()))).select("*", "__x.issue", "__x.how", "__x.phase").drop("__x")


def _format(df: DataFrame, fields: FieldMap) -> DataFrame:
    r = format_rows(df)
    n, s, qq = F.col("n").cast("double"), F.col("s").cast("double"), F.col("qq").cast("double")
    mean = s / n
    sd = F.sqrt(F.greatest((qq - s * s / n) / (n - 1), F.lit(0.0)))
    why = (
        F.when(F.col("how") == "lower", _say("Most answers are in lower case, this one isn't: ", F.col("__repr")))
        .when(F.col("how") == "upper", _say("Most answers begin with a capital, this one doesn't: ", F.col("__repr")))
        .when(F.col("how") == "with", _say("Most answers end in punctuation, this one doesn't: ", F.col("__repr")))
        .when(F.col("how") == "without", _say("Most answers end without punctuation, this one has some: ", F.col("__repr")))
        .otherwise(_say("The answer's ", F.col("a_words"), " words are an outlier (mean ", F.format_string("%.1f", mean), ", standard deviation ", F.format_string("%.1f", sd), ", limit ", F.format_string("%.1f", mean + 3 * sd), "): ", F.col("__repr")))
    )
    long = F.col("issue") == "length_outlier"
    meta = {"answer": F.col("a"), "issue": F.col("issue"), "word_count": F.when(long, F.col("a_words")), "mean_word_count": F.when(long, F.round(mean, 2))}
    return findings(r.withColumn("__repr", py_repr("a")), "inconsistent_format", F.when(long, "medium").otherwise("low"), "format", why, meta, phase=F.col("phase"))


answer_distribution = Scanner("answer_distribution", _distribution, "One answer that makes up 85 % or more of all.")
binary_question_ratio = Scanner("binary_question_ratio", _binary, "More than half of the answers are yes or no.")
duplicate_questions = Scanner("duplicate_questions", _duplicates, "Questions, or questions with their image, that are asked more than once.")
inconsistent_format = Scanner("inconsistent_format", _format, "Answers whose capitals, closing punctuation or length differ from the rest.")
