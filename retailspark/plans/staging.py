"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from retailspark.session import shared_folder


def stage_path(df: DataFrame, name: str) -> str:
    return f"{shared_folder(df.sparkSession)}/retailspark/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write a frame that is read several times once, and read it back.

    The copy survives lost executors, ends the lineage and has a known size.
    """
    path = stage_path(df, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
