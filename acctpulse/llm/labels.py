"""Labelled documents: which are held out, and a bounded sample to fit on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLDS = 5
#: Labels are sent to every executor up to so many rows (16 bytes each); beyond, the join shuffles.
MOST_SENT = 2_000_000


def fold(doc_id: str = "doc_id") -> Column:
    """0 to 4; documents of fold 0 are held out. A null id is in fold 1."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % FOLDS, F.lit(1))


def labelled(labels: DataFrame, label: str, doc_id: str = "doc_id") -> DataFrame:
    """(lb_id, lb_y): one 0/1 label per document outside fold 0; the larger one where labels disagree."""
    known = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull() & (fold(doc_id) != 0))
    return known.groupBy(F.col(doc_id).alias("lb_id")).agg(F.max((F.col(label) > 0).cast("int")).alias("lb_y"))


def join_labels(docs: DataFrame, labels: DataFrame, label: str, doc_id: str = "doc_id") -> DataFrame:
    """Rows of ``docs`` that have a label to learn from, with ``lb_y``."""
    known = labelled(labels, label, doc_id)
    if labels.count() <= MOST_SENT:
        known = F.broadcast(known)
    return docs.join(known, F.col(doc_id) == F.col("lb_id")).drop("lb_id")


def sample(rows: DataFrame, most: int, doc_id: str = "doc_id") -> DataFrame:
    """At most so many rows, the same in every run: those with the least hashes of their ids.

    Of many rows, only those below a hash that lets slightly more pass are sorted, so one task gets about ``most`` rows
    whatever the number of tasks. Rows of few ids, which pass all or none, are sorted as they are."""
    order = F.xxhash64(doc_id)
    n = rows.count()
    if n > 2 * most:
        below = int(2**64 * 1.2 * most / n) - 2**63
        some = rows.where(order < F.lit(below))
        if most <= some.count() <= 2 * most:
            rows = some
    return rows.orderBy(order, doc_id).limit(most)
