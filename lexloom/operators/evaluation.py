"""Classification measures, calibration, model comparison, soft labels, and students trained with Spark ML.

Predictions have truth, predicted, and where needed confidence or probabilities. Rows with a null truth or prediction are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions.text import once
from lexloom.operators import soft
from lexloom.operators.selection import top_k


def nearest_centroid(vectors: DataFrame, id_col: str, vector: str = "embedding", label: str = "label", first: int | None = None, k: int = 3) -> DataFrame:
    """(id, label, predicted, confidence, top_k, probabilities): softmax of the negative squared distances to the classes' mean vectors, of the first `first` dimensions."""
    v = F.slice(vector, 1, first) if first else F.col(vector)
    d = vectors.where(F.col(vector).isNotNull()).select(id_col, label, F.transform(v, lambda x: x.cast("double")).alias("v"))
    each = d.select(label, F.posexplode("v").alias("i", "x")).groupBy(label, "i").agg(F.avg("x").alias("m"))
    cent = each.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("m"))  # one vector for each class
    all_c = cent.agg(F.array_sort(F.collect_list(F.struct(F.col(label).alias("label"), "m"))).alias("cs"))  # classes x dimensions, one row
    dist = lambda c: F.aggregate(F.zip_with("v", c["m"], lambda x, m: (x - m) * (x - m)), F.lit(0.0), lambda a, b: a + b)
    # each step is worked out once for a row: nested array functions would otherwise repeat the ones below them
    s = once(d.crossJoin(F.broadcast(all_c)), _d=F.transform("cs", lambda c: F.struct(c["label"].alias("label"), dist(c).alias("d"))))
    s = once(s, _low=F.array_min(F.transform("_d", lambda x: x["d"])))
    s = once(s, _w=F.transform("_d", lambda x: F.struct(x["label"].alias("label"), F.exp(F.col("_low") - x["d"]).alias("w"))))
    s = once(s, _sum=F.aggregate("_w", F.lit(0.0), lambda a, x: a + x["w"]))
    s = once(s, probabilities=F.transform("_w", lambda x: F.struct(x["label"].alias("label"), (x["w"] / F.col("_sum")).alias("p"))))
    p = once(s, top_k=top_k(F.col("probabilities"), k))
    return p.select(id_col, label, F.get("top_k", F.lit(0))["label"].alias("predicted"), F.get("top_k", F.lit(0))["p"].alias("confidence"), "top_k", "probabilities")


def confusion(p: DataFrame, truth: str = "truth", predicted: str = "predicted") -> DataFrame:
    return p.where(F.col(truth).isNotNull() & F.col(predicted).isNotNull()).groupBy(F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))


def per_class(p: DataFrame, truth: str = "truth", predicted: str = "predicted") -> DataFrame:
    """label, precision, recall, f1, support for each label of truth or prediction; 0 where a denominator is 0. From the confusion counts."""
    c = confusion(p, truth, predicted)
    rows = c.select(F.explode(F.array(F.struct(F.col("truth").alias("label"), F.col("n").alias("t"), F.lit(0).cast("bigint").alias("q"), F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0).alias("h")), F.struct(F.col("predicted").alias("label"), F.lit(0).cast("bigint").alias("t"), F.col("n").alias("q"), F.lit(0).cast("bigint").alias("h")))).alias("x")).select("x.*")
    g = rows.groupBy("label").agg(F.sum("t").alias("support"), F.sum("q").alias("predicted"), F.sum("h").alias("hits"))
    zero = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    g = g.withColumn("precision", zero(F.col("hits"), F.col("predicted"))).withColumn("recall", zero(F.col("hits"), F.col("support")))
    return g.withColumn("f1", F.coalesce(2 * F.col("precision") * F.col("recall") / F.nullif(F.col("precision") + F.col("recall"), F.lit(0.0)), F.lit(0.0)))


def summary(p: DataFrame, truth: str = "truth", predicted: str = "predicted") -> DataFrame:
    """One row: accuracy (equal to each micro average), macro and weighted precision, recall and F1."""
    g = per_class(p, truth, predicted)
    macro = [F.avg(m).alias(f"{m}_macro") for m in ("precision", "recall", "f1")]
    weighted = [(F.sum(F.col(m) * F.col("support")) / F.sum("support")).alias(f"{m}_weighted") for m in ("precision", "recall", "f1")]
    return g.agg((F.sum("hits") / F.sum("support")).alias("accuracy"), *macro, *weighted, (F.sum("hits") / F.sum("predicted")).alias("f1_micro"))


def auc(p: DataFrame, truth: str = "label", probabilities: str = "probabilities") -> DataFrame:
    """Macro mean of the one-vs-rest rank AUC (average ranks for ties). Equal scores are counted together, so ranks need one row for each distinct score."""
    e = p.where(F.col(truth).isNotNull()).select(F.col(truth).alias("t"), F.explode(probabilities).alias("x")).select("t", F.col("x.label").alias("c"), F.col("x.p").alias("s"))
    g = e.groupBy("c", "s").agg(F.count("*").alias("n"), F.sum((F.col("t") == F.col("c")).cast("bigint")).alias("pos"))
    # ranks within buckets of the score, and how many lie in the buckets below: a class is worked on by many tasks
    g = g.withColumn("b", F.coalesce(F.floor(F.least(F.greatest(F.col("s"), F.lit(0.0)), F.lit(1.0)) * 4096).cast("int"), F.lit(-1)))
    w = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    before = g.groupBy("c", "b").agg(F.sum("n").alias("k")).withColumn("before", F.coalesce(F.sum("k").over(w("c").orderBy("b")), F.lit(0))).drop("k")
    g = g.withColumn("inside", F.coalesce(F.sum("n").over(w("c", "b").orderBy("s")), F.lit(0))).join(before, ["c", "b"]).withColumn("below", F.col("inside") + F.col("before"))
    a = g.groupBy("c").agg(F.sum(F.col("pos") * (F.col("below") + (F.col("n") + 1) / 2)).alias("ranks"), F.sum("pos").alias("np"), (F.sum("n") - F.sum("pos")).alias("nn"))
    one = (F.col("ranks") - F.col("np") * (F.col("np") + 1) / 2) / F.nullif(F.col("np") * F.col("nn"), F.lit(0))
    return a.select(one.alias("auc")).agg(F.avg("auc").alias("auc_macro"))


def confidence(p: DataFrame, truth: str = "truth", predicted: str = "predicted", conf: str = "confidence") -> DataFrame:
    """Mean confidence, and the share of rows that are wrong with a confidence above 0.8."""
    return p.agg(F.avg(conf).alias("mean_confidence"), F.avg(F.when((F.col(conf) > 0.8) & (F.col(truth) != F.col(predicted)), 1.0).otherwise(0.0)).alias("overconfidence"))


def calibration_error(p: DataFrame, truth: str = "truth", predicted: str = "predicted", conf: str = "confidence", bins: int = 10) -> DataFrame:
    """Expected calibration error over bins (low, high]; a confidence of 0 is in no bin but counts in the total."""
    n = p.agg(F.count("*").alias("total"))
    b = p.where(F.col(conf) > 0).groupBy(F.ceil(F.col(conf) * bins).alias("bin")).agg(F.count("*").alias("n"), F.avg(conf).alias("c"), F.avg((F.col(truth) == F.col(predicted)).cast("double")).alias("a"))
    return b.crossJoin(F.broadcast(n)).agg(F.coalesce(F.sum(F.abs(F.col("c") - F.col("a")) * F.col("n") / F.col("total")), F.lit(0.0)).alias("ece"))


def compare(models: DataFrame) -> DataFrame:
    """models (name, accuracy, precision, recall, f1, ms, mb) with score and efficiency, and whether it is the best in each figure (lowest ms and mb); ties by name."""
    score = 0.4 * F.col("f1") + 0.3 * F.col("accuracy") + 0.15 * F.col("precision") + 0.15 * F.col("recall")
    d = models.withColumn("score", score).withColumn("efficiency", 1 / (F.col("ms") + 1) + 1 / (F.col("mb") + 1))
    high = ("accuracy", "precision", "recall", "f1", "score", "efficiency")
    best = d.agg(*[F.max_by("name", F.struct(c, "name")).alias(f"_{c}") for c in high], *[F.min_by("name", F.struct(c, "name")).alias(f"_{c}") for c in ("ms", "mb")])
    d = d.crossJoin(F.broadcast(best))
    for c in (*high, "ms", "mb"):
        d = d.withColumn(f"best_{c}", F.col("name") == F.col(f"_{c}")).drop(f"_{c}")
    return d


def report(p: DataFrame, conf: str = "confidence", ms: Column | None = None, truth: str = "truth", predicted: str = "predicted") -> DataFrame:
    """Totals, mean time, throughput, confidence bands (> 0.9; 0.7 to 0.9; 0.5 to 0.7; below), accuracy."""
    t = F.avg(ms) if ms is not None else F.lit(0.0)
    c = F.col(conf)
    band = lambda cond: F.sum(cond.cast("bigint"))
    return p.agg(F.count("*").alias("total"), t.alias("mean_ms"), F.coalesce(1000 / F.nullif(t, F.lit(0.0)), F.lit(0.0)).alias("per_second"), F.avg(c).alias("mean_confidence"), band(c > 0.9).alias("very_high"), band((c >= 0.7) & (c <= 0.9)).alias("high"), band((c >= 0.5) & (c < 0.7)).alias("medium"), band(c < 0.5).alias("low"), F.avg((F.col(truth) == F.col(predicted)).cast("double")).alias("accuracy"))


def flatten_top(p: DataFrame, id_col: str, k: int = 3) -> DataFrame:
    """One column for the label and the confidence of each of the k best; null where there are fewer."""
    return p.select(id_col, "predicted", "confidence", *[F.get("top_k", F.lit(i))["label" if part == "label" else "p"].alias(f"top_{i + 1}_{part}") for i in range(k) for part in ("label", "confidence")])


def softmax(a: Column, temperature: float = 1.0) -> Column:
    e = F.transform(a, lambda x: F.exp((x - F.array_max(a)) / temperature))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda s, y: s + y))


def soft_loss(teacher: Column, student: Column, target: Column, temperature: float = 2.0, wd: float = 0.7, ws: float = 0.3) -> Column:
    """struct(kl, ce, total): KL of the softened teacher to the softened student times T^2, cross-entropy with the target index (from 0), and their weighted sum."""
    t, s = softmax(teacher, temperature), softmax(student, temperature)
    kl = F.aggregate(F.zip_with(t, s, lambda a, b: F.when(a > 0, a * (F.log(a) - F.log(F.greatest(b, F.lit(1e-300))))).otherwise(0.0)), F.lit(0.0), lambda x, y: x + y) * temperature**2
    ce = -F.log(F.get(softmax(student), target))
    return F.struct(kl.alias("kl"), ce.alias("ce"), (wd * kl + ws * ce).alias("total"))


def unit(a: Column) -> Column:
    n = F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(a, lambda x: x / F.nullif(n, F.lit(0.0)))


def feature_loss(a: Column, b: Column) -> Column:
    """Mean squared difference of two vectors of length one."""
    return F.aggregate(F.zip_with(unit(a), unit(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x) / F.size(a)


def adaptive_weights(df: DataFrame, key: str, order: list[str], distill: str, hard: str, start: tuple[float, float] = (0.7, 0.3)) -> DataFrame:
    """(key, step, w_distill, w_hard): after ten steps each weight moves by 0.01 times (its target - its share of the loss), within 0.1 and 0.9, and both are scaled to add up to 1.

    Each run's steps are sorted and streamed through one batched function, which carries four numbers from step to step; a run is never gathered.
    """
    from pyspark.sql.types import StructField, StructType

    schema = StructType([StructField(key, df.schema[key].dataType), *StructType.fromDDL("step int, w_distill double, w_hard double").fields])
    rows = df.select(key, *order, F.col(distill).cast("double").alias("_d"), F.col(hard).cast("double").alias("_h"))

    def run(parts):
        import pandas as pd

        now, k, d, h = None, 0, *start
        for pdf in parts:
            out = []
            for name, x, y in zip(pdf[key], pdf["_d"], pdf["_h"]):
                if k == 0 or name != now and not (pd.isna(name) and pd.isna(now)):
                    now, k, d, h = name, 0, *start
                total = x + y
                if k >= 10 and total > 0:
                    nd = min(max(d + 0.01 * (start[0] - x / total), 0.1), 0.9)
                    nh = min(max(h + 0.01 * (start[1] - y / total), 0.1), 0.9)
                    d, h = nd / (nd + nh), nh / (nd + nh)
                k += 1
                out.append((name, k, d, h))
            yield pd.DataFrame(out, columns=[key, "step", "w_distill", "w_hard"])

    return rows.repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, schema)


def epoch_metrics(batches: DataFrame) -> DataFrame:
    """Per epoch: sum of the losses over all batches, failed ones included in the count."""
    return batches.groupBy("epoch").agg((F.coalesce(F.sum("loss"), F.lit(0.0)) / F.count("*")).alias("loss"), F.count("*").alias("n_batches"))


def learning_rates(spark, total: int, ratio: float = 0.1, peak: float = 2e-5) -> DataFrame:
    """(step, rate): rate rises to peak over the first int(total * ratio) steps, then falls to 0."""
    w = int(total * ratio)
    d = spark.range(1, total + 1).select(F.col("id").alias("step"))
    return d.withColumn("rate", F.when(F.col("step") <= w, peak * F.col("step") / max(w, 1)).otherwise(peak * (total - F.col("step")) / max(total - w, 1)))


def early_stop_patience(epochs: Column) -> Column:
    return F.greatest(F.lit(2), F.least(F.lit(10), F.floor(0.25 * epochs).cast("int")))


def size_mb(parameters: Column) -> Column:
    return parameters * 4 / 2**20


def report_lines(s: DataFrame) -> DataFrame:
    """summary() as lines of a fixed-width text."""
    names = [c for c, t in s.dtypes if t == "double"]
    rows = F.array(*[F.format_string("%-20s%10.4f", F.lit(c), F.col(c)) for c in names])
    return s.select(F.posexplode(rows).alias("line_no", "line"))


def metric_line(s: DataFrame) -> DataFrame:
    return s.select(F.format_string("accuracy=%.4f, f1_macro=%.4f, f1_weighted=%.4f", "accuracy", "f1_macro", "f1_weighted").alias("line"))


def word_stages(text: str = "text", features: int = 1 << 14) -> list:
    """The stages that turn a text to its words' counts by hash, as column `features`."""
    from pyspark.ml.feature import HashingTF, RegexTokenizer

    return [RegexTokenizer(inputCol=text, outputCol="words", pattern=r"[\p{L}\p{N}_]+", gaps=False), HashingTF(inputCol="words", outputCol="features", numFeatures=features)]


def with_words(rows: DataFrame, text: str = "text", features: int = 1 << 14) -> DataFrame:
    """rows that have a text, with their column `features`."""
    from pyspark.ml import PipelineModel

    return PipelineModel(word_stages(text, features)).transform(rows.where(f"{text} is not null")).drop("words")


def student(rows: DataFrame, teacher: str, label_id: str, alpha: float = 0.7):
    """train_student for rows that have `features`: the logistic regression alone."""
    target = F.transform(teacher, lambda p, y: alpha * p + (1 - alpha) * (y == F.col(label_id)).cast("double"))
    return soft.fit(rows.where(f"{label_id} is not null").select("features", target.alias("target")), "target")


def naive_bayes(rows: DataFrame, label_id: str):
    """train_hard for rows that have `features`: the naive Bayes model alone."""
    from pyspark.ml.classification import NaiveBayes

    return NaiveBayes(featuresCol="features", labelCol="target").fit(rows.where(f"{label_id} is not null").select("features", F.col(label_id).cast("double").alias("target")))


def train_student(rows: DataFrame, teacher: str, label_id: str, text: str = "text", alpha: float = 0.7, features: int = 1 << 14):
    """A logistic regression on hashed words that follows the teacher's probabilities (an array) with weight alpha and the label with 1 - alpha. Returns a pipeline model; a table without rows is an error."""
    from pyspark.ml import PipelineModel

    return PipelineModel([*word_stages(text, features), student(with_words(rows, text, features), teacher, label_id, alpha)])


def train_hard(rows: DataFrame, label_id: str, text: str = "text", features: int = 1 << 14):
    """The same student on labels alone."""
    from pyspark.ml import PipelineModel

    return PipelineModel([*word_stages(text, features), naive_bayes(with_words(rows, text, features), label_id)])


def infer(rows: DataFrame, predict, id_col: str, text: str = "text", batch: int = 1000) -> DataFrame:
    """(id, predicted, confidence) of an external model: `predict` takes a list of texts and gives (label, confidence) pairs. A batch that fails is tried text by text; a text that fails has label ERROR and confidence 0."""
    import pandas as pd

    def run(frames):
        for pdf in frames:
            for s in range(0, len(pdf), batch):
                part = pdf.iloc[s : s + batch]
                texts = list(part["t"])
                try:
                    got = list(predict(texts))
                except Exception:
                    got = []
                    for t in texts:
                        try:
                            got += list(predict([t]))
                        except Exception:
                            got.append(("ERROR", 0.0))
                yield pd.DataFrame({id_col: part[id_col], "predicted": [g[0] for g in got], "confidence": [float(g[1]) for g in got]})

    kind = rows.schema[id_col].dataType.simpleString()
    return rows.select(id_col, F.col(text).alias("t")).mapInPandas(run, f"{id_col} {kind}, predicted string, confidence double")


def registry(models: DataFrame, meta: str = "meta") -> DataFrame:
    """models with params, size_mb, n_labels and architecture from their JSON metadata."""
    m = F.from_json(meta, "struct<params: bigint, labels: array<string>, architecture: string>")
    return models.withColumn("_m", m).select(*models.columns, F.col("_m.params").alias("params"), size_mb(F.col("_m.params")).alias("size_mb"), F.coalesce(F.size("_m.labels"), F.lit(0)).alias("n_labels"), F.col("_m.architecture").alias("architecture")).drop("_m")
