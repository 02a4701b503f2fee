"""Parts of a full worker name, `wallet.worker`."""

from pyspark.sql import Column, functions as F


def wallet_name(workerfull: Column) -> Column:
    """Text before the first dot; the whole text when there is none."""
    return F.substring_index(workerfull, ".", 1)


def worker_name(workerfull: Column) -> Column:
    """Text between the first and the second dot; empty when there is no dot."""
    return F.coalesce(F.get(F.split(workerfull, r"\."), F.lit(1)), F.lit(""))
