"""Classifier evaluation (A14) and operating points (D7) as distributed
aggregates; ROC-AUC by the rank-sum identity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlens.operators.topk import prefix_sums


def confusion(df: DataFrame, label_col: str, pred_col: str) -> DataFrame:
    """(label, prediction, count) -- the confusion matrix in long form."""
    return df.groupBy(F.col(label_col).alias("label"), F.col(pred_col).alias("prediction")) \
        .agg(F.count(F.lit(1)).alias("count"))


def per_class(df: DataFrame, label_col: str, pred_col: str) -> DataFrame:
    """precision, recall, F1 and support per class, plus accuracy.
    Built from the confusion table (classes^2 rows), never the rows."""
    cm = confusion(df, label_col, pred_col)
    tp = cm.where(F.col("label") == F.col("prediction")).select(F.col("label").alias("cls"), F.col("count").alias("tp"))
    sup = cm.groupBy(F.col("label").alias("cls")).agg(F.sum("count").alias("support"))
    pred = cm.groupBy(F.col("prediction").alias("cls")).agg(F.sum("count").alias("predicted"))
    out = sup.join(pred, "cls", "full").join(tp, "cls", "left").fillna(0, ["tp", "support", "predicted"])
    prec = F.when(F.col("predicted") > 0, F.col("tp") / F.col("predicted")).otherwise(F.lit(0.0))
    rec = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(F.lit(0.0))
    f1 = F.when(prec + rec > 0, 2 * prec * rec / (prec + rec)).otherwise(F.lit(0.0))
    whole = Window.partitionBy()
    return out.select("cls", "support", "predicted", "tp", prec.alias("precision"), rec.alias("recall"),
                      f1.alias("f1"),
                      (F.sum("tp").over(whole) / F.sum("support").over(whole)).alias("accuracy"))


def score_table(df: DataFrame, label_col: str, score_col: str) -> DataFrame:
    """(score, pos, neg) per distinct score, with running totals of the
    positives and negatives at higher scores (skew-safe prefix sums)."""
    t = df.groupBy(F.col(score_col).cast("double").alias("score")).agg(
        F.count_if(F.col(label_col) == 1).alias("pos"), F.count_if(F.col(label_col) != 1).alias("neg"))
    return prefix_sums(t, [], "score", ["pos", "neg"], descending=True, prefix="above_")


def roc_auc(df: DataFrame, label_col: str, score_col: str) -> DataFrame:
    """AUC = P(score_pos > score_neg) + 0.5 P(tie); 0 when one class is
    absent (A14). One row: auc, positives, negatives."""
    t = score_table(df, label_col, score_col)
    agg = t.agg(F.sum(F.col("neg") * (F.col("above_pos") + 0.5 * F.col("pos"))).alias("w"),
                F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"))
    auc = F.when((F.col("positives") > 0) & (F.col("negatives") > 0),
                 F.col("w") / (F.col("positives") * F.col("negatives"))).otherwise(F.lit(0.0))
    return agg.select(auc.alias("auc"), "positives", "negatives")


def operating_points(df: DataFrame, label_col: str, score_col: str) -> DataFrame:
    """Threshold sweep (D7): for every distinct score s, the confusion of the
    rule score >= s, with TPR, FPR and precision."""
    t = score_table(df, label_col, score_col)
    tot = t.agg(F.sum("pos").alias("P"), F.sum("neg").alias("N")).first()
    j = t.withColumns({"P": F.lit(tot["P"] or 0), "N": F.lit(tot["N"] or 0)})
    tp, fp = F.col("above_pos") + F.col("pos"), F.col("above_neg") + F.col("neg")
    return j.select("score", tp.alias("tp"), fp.alias("fp"), (F.col("P") - tp).alias("fn"),
                    (F.col("N") - fp).alias("tn"),
                    F.when(F.col("P") > 0, tp / F.col("P")).alias("tpr"),
                    F.when(F.col("N") > 0, fp / F.col("N")).alias("fpr"),
                    F.when(tp + fp > 0, tp / (tp + fp)).alias("precision"))


def fpr_at_tpr(df: DataFrame, label_col: str, score_col: str, tpr: float = 0.95) -> DataFrame:
    """Lowest false-positive rate reaching the target true-positive rate."""
    return operating_points(df, label_col, score_col).where(F.col("tpr") >= tpr) \
        .agg(F.min("fpr").alias("fpr_at_tpr"))
