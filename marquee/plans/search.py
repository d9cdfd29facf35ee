"""Text search over the film catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.operators.postings import token_index
from marquee.sources.shop import Shop


def film_index(shop: Shop) -> DataFrame:
    """(term, film_id, tf) over titles and descriptions."""
    texts = shop.film.select("film_id", F.concat_ws(" ", "title", "description").alias("text"))
    return token_index(texts, doc_id="film_id").withColumnRenamed("doc_id", "film_id")
