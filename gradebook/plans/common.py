"""Shared building blocks for catalogue queries (graded fact tables of the fixture views)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import summary as S
from ..operators.grading import grade
from ..sources import fixtures as fx

TEMPS = [t for _, t in fx.TEMPS]
REP_KEYS = ["temperature", "model"]


def graded_t0(spark: SparkSession, sf: str) -> DataFrame:
    return grade(fx.responses_t0(spark, sf))


def graded_rep(spark: SparkSession, sf: str, only=fx.SHEETS) -> DataFrame:
    return grade(fx.responses_rep(spark, sf, only=only))


def graded_m2(spark: SparkSession, sf: str) -> DataFrame:
    return grade(fx.responses_machine2(spark, sf))


def votes_rep(spark: SparkSession, sf: str, identify_majority: bool = True) -> DataFrame:
    return S.plurality_vote(graded_rep(spark, sf), [*REP_KEYS, "case_id"], identify_majority=identify_majority)


def per_case_rep(spark: SparkSession, sf: str) -> DataFrame:
    return S.correct_per_case(graded_rep(spark, sf), REP_KEYS)
