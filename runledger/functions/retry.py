"""Retry policy as column expressions. Durations are nanoseconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: What an unset policy means, in nanoseconds.
INITIAL, COEFFICIENT, MAXIMUM = 1_000_000_000, 2.0, 100_000_000_000


def policy(initial: Column, coefficient: Column, maximum: Column) -> tuple[Column, Column, Column]:
    """A policy's intervals and coefficient with zeros and nulls filled in; the longest interval is 100 first ones, at most MAXIMUM."""
    first = F.coalesce(F.nullif(initial, F.lit(0)), F.lit(INITIAL)).cast("bigint")
    grow = F.coalesce(F.nullif(coefficient, F.lit(0.0)), F.lit(COEFFICIENT))
    return first, grow, F.coalesce(F.nullif(maximum, F.lit(0)), F.least(first * 100, F.lit(MAXIMUM))).cast("bigint")


def policy_error(initial: Column, coefficient: Column, maximum: Column, attempts: Column) -> Column:
    """What is wrong with a policy after policy(), or null."""
    return (
        F.when(initial < 0, "negative initial interval")
        .when(coefficient < 1, "coefficient under 1")
        .when(maximum < initial, "maximum under initial interval")
        .when(attempts < 0, "negative attempts")
    )


def error_type(kind: Column, name: Column, timeout: Column) -> Column:
    """The type by which policies tell an error: that of an application error, or of a timeout with its kind."""
    return F.when(kind == "application", F.coalesce(name, F.lit(""))).when(kind == "timeout", F.concat(F.lit("TimeoutError:"), timeout)).otherwise("")


def retryable(kind: Column, non_retryable: Column) -> Column:
    """Whether an error may be retried at all: cancels, terminations and panics never, application errors as they say."""
    return kind.isNotNull() & ~kind.isin("canceled", "terminated", "panic") & ~((kind == "application") & F.coalesce(non_retryable, F.lit(False)))


def client_backoff(attempt: Column, initial: Column, coefficient: Column, maximum: Column, jitter: Column, retry_after: Column) -> Column:
    """A client's wait: between half of the grown interval and all of it, by jitter in [0, 1); what the server asks for if longer."""
    grown = initial.cast("double") * F.pow(coefficient, F.greatest(attempt, F.lit(1)) - 1)
    bounded = F.when((maximum > 0) & (grown > maximum), maximum.cast("double")).otherwise(grown)
    part = F.least(F.greatest(F.coalesce(F.nanvl(jitter, F.lit(0.0)), F.lit(0.0)), F.lit(0.0)), F.lit(1.0 - 2.0**-53))
    return F.greatest((bounded * (0.5 + 0.5 * part)).cast("bigint"), F.coalesce(retry_after, F.lit(0)))


def scan_wait(failures: Column, interval: int, longest: int, jitter: float, random: Column) -> Column:
    """The wait before the next scan: the interval, doubled for each failure up to the longest, spread by jitter."""
    grown = F.least(F.lit(float(interval)) * F.pow(F.lit(2.0), F.greatest(failures, F.lit(0))), F.lit(float(longest)))
    return (F.when(failures > 0, grown).otherwise(float(interval)) * (1 + jitter * random)).cast("bigint")


def backoff(attempt: Column, initial: Column, coefficient: Column, maximum: Column, jitter: Column) -> Column:
    """initial * coefficient^(attempt - 1), at most maximum, plus up to a fifth by jitter in [0, 1]; whole nanoseconds."""
    grown = initial * F.pow(coefficient, F.greatest(attempt, F.lit(1)) - 1)
    bounded = F.least(F.greatest(jitter, F.lit(0.0)), F.lit(1.0))
    return (F.least(grown, maximum) * (1 + bounded * 0.2)).cast("bigint")


def retried(error_type: Column, retryable: Column, attempt: Column, maximum_attempts: Column, excluded: Column) -> Column:
    """Whether a failed attempt is tried again."""
    spent = (maximum_attempts > 0) & (attempt >= maximum_attempts)
    return error_type.isNotNull() & retryable & ~spent & ~F.coalesce(F.array_contains(excluded, error_type), F.lit(False))
