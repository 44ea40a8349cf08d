"""Shared by the registered queries."""

from pyspark.sql import DataFrame, SparkSession

from folioforge.operators.classify import Category


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A small glossary over the vocabulary of the test tables.
GLOSSARY = (
    Category("licence", ("licensed under", "license", "version 2", "all rights reserved", "released under")),
    Category("english", ("the", "of", "and", "that", "with"), weight=0.5, primary=0.4, secondary=0.3),
    Category("secret", ("token", "password", "secret", "api_key"), weight=1.5),
    Category("german", ("und", "der", "die", "das", "für"), primary=0.3),
)
