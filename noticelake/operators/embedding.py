"""Embedding jobs: what is outstanding, the vectorizer plug-in, the upsert."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from noticelake.functions.text import notice_text, profile_text, text_digest
from noticelake.functions.vectors import hashing_vector
from noticelake.sources.tables import upsert

MODEL = "hashing-64"
BATCH = 64

# A vectorizer factory is called once per Python worker and returns a function
# from a list of texts to a list of vectors.
Vectorizer = Callable[[], Callable[[list[str]], list]]


def notice_texts(notices: DataFrame) -> DataFrame:
    return notices.select("id", "published_at", notice_text(
        F.col("title"), F.col("description")).alias("text"))


def profile_texts(profiles: DataFrame) -> DataFrame:
    return profiles.select("user_id", profile_text(
        F.col("business_description"), F.col("category_keywords"),
        F.col("enlistment_categories"), F.col("experience_summary")).alias("text"))


def needs_embedding(notices: DataFrame, embeddings: DataFrame, model: str = MODEL,
                    limit: int | None = None) -> DataFrame:
    """Live notices without a vector of this model for their present text.

    The digest comparison also catches a notice whose text changed; empty texts
    are never embedded. ``limit`` keeps the newest, as one run's budget."""
    texts = (notice_texts(notices.filter("status = 'live'")).filter("text <> ''")
             .withColumn("text_digest", text_digest(F.col("text"))))
    done = embeddings.filter(F.col("model") == model).select("id", "text_digest")
    todo = texts.join(done, ["id", "text_digest"], "left_anti")
    if limit is None:
        return todo
    return todo.orderBy(F.col("published_at").desc_nulls_last(), "id").limit(limit)


def embed(todo: DataFrame, vectorizer: Vectorizer | None = None, model: str = MODEL,
          dimensions: int = 64) -> DataFrame:
    """Vectors for (id, text, text_digest) rows.

    Without a vectorizer the JVM hashing vector is used. With one, batches go
    through Arrow and the model is loaded once per worker."""
    if vectorizer is None:
        return todo.select("id", hashing_vector(F.col("text"), dimensions).alias("embedding"), F.lit(model).alias("model"),
                           F.col("text").alias("source_text"), "text_digest")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = vectorizer()
        for batch in batches:
            texts = batch["text"].tolist()
            vectors = []
            for start in range(0, len(texts), BATCH):
                vectors.extend(encode(texts[start:start + BATCH]))
            yield pd.DataFrame({
                "id": batch["id"], "embedding": vectors, "model": model,
                "source_text": texts,
                "text_digest": batch["text_digest"]})

    return todo.select("id", "text", "text_digest").mapInPandas(
        run, "id long, embedding array<float>, model string, source_text string, text_digest string")


def upsert_embeddings(current: DataFrame, fresh: DataFrame) -> DataFrame:
    """A vector replaces the stored one of its id."""
    return upsert(current, fresh.withColumn("_at", F.lit(0)), ["id"], "_at")


def embed_profiles(profiles: DataFrame, vectorizer: Vectorizer | None = None, model: str = MODEL,
                   dimensions: int = 64) -> DataFrame:
    """(user_id, embedding, model), by the same vectorizer and model as the notices."""
    texts = profile_texts(profiles).filter("text <> ''").select(
        F.col("user_id").alias("id"), "text", F.lit("").alias("text_digest"))
    return embed(texts, vectorizer, model, dimensions).select(F.col("id").alias("user_id"), "embedding", "model")
