"""A bounded, seeded sample of labelled texts, on which the classifiers are fitted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, keep: Column, rows: int, id_col: str = "doc_id", text_col: str = "text", seed: int = 3) -> list[tuple[int, str, int]]:
    """Up to ``rows`` of (id, text, label), in the order of a seeded hash of the id; null labels and ids are left out.

    ``keep`` is a condition on the id. The ids are chosen first, so that only the chosen texts leave the executors.
    An id with several texts gives each of them; of several labels of an id the largest counts.
    """
    of = labels.filter(F.col(label).isNotNull() & F.col(id_col).isNotNull() & keep).groupBy(F.col(id_col).alias("id")).agg(F.max(label).alias("label"))
    order = F.xxhash64("id", F.lit(seed))
    chosen = of.orderBy(order, "id").limit(rows)
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = texts.join(F.broadcast(chosen), "id").orderBy(order, "id", "text").limit(rows).collect()
    return [(r["id"], r["text"], int(r["label"])) for r in found]
