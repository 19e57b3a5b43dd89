"""Public entry point: ``validate(df, rules, as_of=...) -> Validated``.

Plan shape: scan → (row numbers) → one join per UNIQUE / REFERENCE field → one
projection holding the error array and the normalized columns. The three outputs
(cleaned rows, long error report, statistics) are lazy DataFrames over that plan;
call ``persist()`` on ``Validated.frame`` only when more than one of them is acted on.
"""

from __future__ import annotations

import uuid
from datetime import datetime
from typing import Mapping

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tabvet.functions.phone import DEFAULT_PLAN, join_plan, row_region
from tabvet.operators.checks import CheckContext
from tabvet.operators.keys import with_reference_flag, with_unique_flag
from tabvet.operators.rownum import with_row_numbers
from tabvet.plans.compile import Compiled, KeyFlags, compile_rules
from tabvet.plans.rules import RuleError, RuleSet
from tabvet.sources.readers import balanced

ROW = "row_number"
SOURCE = "_source"  # the row's file inside a validated frame; reports call it source_file


JIT_BYTES = "8000"  # HotSpot compiles no larger method, so a larger stage is interpreted row by row


def _split_large_stages(spark) -> None:
    """A stage whose method is too large for HotSpot runs as its operators' own, smaller methods, unless the session sets a limit."""
    limit = "spark.sql.codegen.hugeMethodLimit"
    if spark.conf.get(limit) == "65535":  # Spark's default
        spark.conf.set(limit, JIT_BYTES)


def as_of_literal(as_of: datetime | str) -> Column:
    text = as_of.isoformat(sep=" ") if isinstance(as_of, datetime) else str(as_of)
    return F.lit(text).cast("timestamp_ntz")


class Validated:
    """Lazy results of one validation run."""

    def __init__(self, frame: DataFrame, rules: RuleSet, input_columns: list[str], compiled: Compiled,
                 overwrite: bool = False):
        self.frame = frame
        self.rules = rules
        self.input_columns = input_columns
        self.compiled = compiled
        self.normalized_columns = [name for name, _ in compiled.normalized]
        self.overwrite = overwrite

    @property
    def identity(self) -> list[str]:
        """The columns that identify and order rows: the source file, if known, and the row number."""
        return [SOURCE, ROW] if SOURCE in self.frame.columns else [ROW]

    def on(self, frame: DataFrame) -> Validated:
        """The same results over a stored copy of the frame."""
        return Validated(frame, self.rules, self.input_columns, self.compiled, self.overwrite)

    # P2
    def is_valid(self) -> Column:
        masks = [F.col(name) == 0 for name, _ in self.compiled.masks]
        if not masks:
            return F.lit(True)
        out = masks[0]
        for m in masks[1:]:
            out = out & m
        return out

    # Messages (not codes) in report order, "; "-separated, "" when valid
    def error_summary(self) -> Column:
        slots = self.compiled.slots
        if not slots:
            return F.lit("")
        return F.concat_ws("; ", *[F.when(s.failed(), s.message_col()) for s in slots])

    # P2, P3, P4, P5, P6
    def _cleaned_columns(self) -> list[Column]:
        clash = {"is_valid", "error_summary"} & set(self.input_columns)
        if clash and not self.overwrite:
            raise RuleError(f"input already has column(s) {sorted(clash)}; pass overwrite=True to replace them")
        keep = [c for c in self.input_columns if c not in clash and c not in self.normalized_columns]
        return [*[F.col(c) for c in keep], self.is_valid().alias("is_valid"),
                self.error_summary().alias("error_summary"), *[F.col(c) for c in self.normalized_columns]]

    def cleaned(self, valid_only: bool = False) -> DataFrame:
        out = self.frame.select(*self._cleaned_columns())
        return out.where("is_valid") if valid_only else out

    def with_row_number(self, valid_only: bool = False, source: bool = False) -> DataFrame:
        """Cleaned rows plus ``row_number`` and, with ``source``, all identity columns (needed to lay rows out in input order)."""
        out = self.frame.select(*(self.identity if source else [ROW]), *self._cleaned_columns())
        return out.where("is_valid") if valid_only else out

    # E2
    def errors(self, with_order: bool = False) -> DataFrame:
        """Long error table, one row per error, with its ``source_file`` if rows come from files. ``with_order`` keeps ``ordinal``/``seq``."""
        slots = self.compiled.slots
        cols = ["row_number", "ordinal", "seq", "field_name", "error_code", "error_message"]
        files = [F.col(SOURCE).alias("source_file")] if SOURCE in self.frame.columns else []
        if not slots:
            empty = self.frame.sparkSession.createDataFrame(
                [], ("source_file string, " if files else "") + "row_number bigint, ordinal int, seq int, field_name string, "
                    "error_code string, error_message string")
            return empty if with_order else empty.drop("ordinal", "seq")
        ids = F.explode(F.array(*[F.when(s.failed(), F.lit(s.k)) for s in slots])).alias("_k")
        hit = (self.frame.where(~self.is_valid())
               .select(*files, F.col(ROW).cast("long").alias(ROW), ids, *[s.dynamic for s in slots if s.dynamic])
               .where(F.col("_k").isNotNull()))
        pos = F.col("_k") + 1
        lit_array = lambda vals: F.array(*[F.lit(v) for v in vals])
        message = F.element_at(lit_array([s.message or "" for s in slots]), pos)
        for s in slots:
            if s.dynamic:
                message = F.when(F.col("_k") == s.k, F.col(s.dynamic)).otherwise(message)
        files = ["source_file"] if files else []
        out = hit.select(
            *files, ROW,
            F.element_at(lit_array([s.ordinal for s in slots]), pos).cast("int").alias("ordinal"),
            F.element_at(lit_array([s.seq for s in slots]), pos).cast("int").alias("seq"),
            F.element_at(lit_array([s.field for s in slots]), pos).alias("field_name"),
            F.element_at(lit_array([s.code for s in slots]), pos).alias("error_code"),
            message.alias("error_message"))
        return out.select(*files, *cols) if with_order else out.select(*files, ROW, *cols[3:])

    # L3
    def error_report(self) -> DataFrame:
        """Errors in report order: source file, rule order, then row, then order inside the cell."""
        errors = self.errors(with_order=True)
        files = [c for c in ("source_file",) if c in errors.columns]
        return errors.orderBy(*files, "ordinal", ROW, "seq").select(*files, ROW, "field_name", "error_code", "error_message")

    # A1, A2, A3 as metrics of a pass that is made anyway
    def observed(self, observation: Observation) -> DataFrame:
        """The frame with its statistics counted by whichever job reads it whole."""
        return self.frame.observe(
            observation, F.count(F.lit(1)).alias("total_rows"), F.count_if(self.is_valid()).alias("valid_rows"),
            F.coalesce(F.sum(self._error_count()), F.lit(0)).alias("error_count"),
            *[F.coalesce(F.sum(self._code_count(c)), F.lit(0)).alias(f"code_{c}") for c in self.compiled.codes])

    def _code_count(self, code: str) -> Column:
        terms = [s.failed().cast("long") for s in self.compiled.slots if s.code == code]
        out = terms[0]
        for t in terms[1:]:
            out = out + t
        return out

    def _error_count(self) -> Column:
        terms = [F.bit_count(F.col(name)).cast("long") for name, _ in self.compiled.masks]
        if not terms:
            return F.lit(0).cast("long")
        out = terms[0]
        for t in terms[1:]:
            out = out + t
        return out

    # A2
    def errors_by_code(self) -> DataFrame:
        """(error_code, error_count) for every code that occurred; one pass, no explode of rows."""
        codes = self.compiled.codes
        if not codes:
            return self.frame.sparkSession.createDataFrame([], "error_code string, error_count bigint")
        sums = self.frame.agg(*[F.sum(self._code_count(c)).alias(f"_c{i}") for i, c in enumerate(codes)])
        pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("error_code"), F.col(f"_c{i}").alias("error_count"))
                                    for i, c in enumerate(codes)]))
        return sums.select(pairs.alias("p")).select("p.*").where(F.col("error_count") > 0)

    # A1, A2, A3, A4 in one pass
    def stats(self, chunk_rows: int = 100_000, valid_only: bool = False) -> DataFrame:
        if chunk_rows <= 0:
            raise RuleError("chunk_rows must be positive")
        codes = self.compiled.codes
        agg = self.frame.agg(
            F.count(F.lit(1)).alias("total_rows"),
            F.sum(F.when(self.is_valid(), 1).otherwise(0)).cast("long").alias("valid_rows"),
            F.sum(self._error_count()).cast("long").alias("error_count"),
            *[F.sum(self._code_count(c)).alias(f"_c{i}") for i, c in enumerate(codes)])
        total, valid = F.col("total_rows"), F.coalesce(F.col("valid_rows"), F.lit(0))
        out_rows = valid if valid_only else total
        entries = [F.struct(F.lit(c).alias("key"), F.coalesce(F.col(f"_c{i}"), F.lit(0)).alias("value"))
                   for i, c in enumerate(codes)]
        by_code = (F.map_from_entries(F.filter(F.array(*entries), lambda e: e["value"] > 0)) if entries
                   else F.create_map().cast("map<string,bigint>"))
        return agg.select(
            total.alias("total_rows"),
            valid.alias("valid_rows"),
            (total - valid).alias("invalid_rows"),
            F.when(total > 0, F.bround(F.lit(100.0) * valid / total, 2)).otherwise(F.lit(0.0)).alias("valid_percentage"),
            by_code.alias("errors_by_code"),
            F.coalesce(F.col("error_count"), F.lit(0)).alias("error_count"),
            F.greatest(F.lit(1), F.ceil(out_rows / F.lit(chunk_rows))).cast("int").alias("output_chunks"),
        )


def validate(df: DataFrame, rules: RuleSet, *, as_of: datetime | str, row_number: str | None = None,
             refs: Mapping[str, DataFrame] | None = None, date_policy: str = "formats",
             phone_region: str = "row", phone_plan=DEFAULT_PLAN, overwrite: bool = False,
             salt_buckets: int | None = None, partitions: int | None = None, source_file: str | None = None) -> Validated:
    """Compile ``rules`` against ``df`` (all columns treated as text).

    ``row_number``: name of a column holding the row identity to report; by default
    the file position + 2 (parquet row index, or the block-based plan for CSV).
    ``source_file``: name of a column that tells the rows' files apart, with ``row_number``; rows
    numbered here carry their file's path.
    ``refs``: parent tables for fields with a ``references`` constraint, by dataset.
    ``date_policy``: ``formats`` (cross checks parse with the field's formats first)
    or ``month_first`` (free-form only, the reference's cross-check behaviour).
    ``phone_region``: ``row`` (normalize with the row's region) or ``default``.
    ``phone_plan``: the numbering plan, ``PlanEntry`` rows (``plan_from_table`` reads them from a table).
    ``partitions``: deal the rows over so many partitions after row numbering, for an input
    that is known to come in too few splits (a single unsplittable file). Off by default.
    No job runs before an action on the result.
    """
    if date_policy not in ("formats", "month_first"):
        raise RuleError(f"unknown date_policy {date_policy!r}")
    if phone_region not in ("row", "default"):
        raise RuleError(f"unknown phone_region {phone_region!r}")
    spark = df.sparkSession
    _split_large_stages(spark)
    input_columns = [c for c in df.columns if c != row_number]
    if source_file is not None:
        df = df.withColumn(SOURCE, F.col(source_file).cast("string"))
    if row_number is None:
        df = with_row_numbers(df, ROW, None if source_file else SOURCE)
    elif row_number != ROW:
        if ROW in df.columns:
            raise RuleError(f"input has a column named {ROW!r}; pass row_number={ROW!r} to use it")
        df = df.withColumnRenamed(row_number, ROW)
    df = balanced(df, partitions)
    buckets = salt_buckets or max(8, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
    salt = F.col(ROW)

    flags: dict[str, KeyFlags] = {}
    for i, rule in enumerate(rules.fields):
        if rule.name not in input_columns:
            continue
        uq = rf = None
        target = ""
        if rule.unique:
            uq = f"_uq{i}"
            df = with_unique_flag(df, rule.name, uq, salt, buckets)
        ref = rule.reference
        if ref is not None:
            parent = (refs or {}).get(ref.dataset)
            if parent is None:
                raise RuleError(f"{rules.dataset}.{rule.name} references {ref.dataset}, which was not given")
            rf = f"_rf{i}"
            target = f"{ref.dataset}.{ref.field}"
            df = with_reference_flag(df, rule.name, parent, ref.field, rf, salt, buckets)
        if uq or rf:
            flags[rule.name] = KeyFlags(uq, rf, target)

    ctx = CheckContext(rules, tuple(input_columns), as_of_literal(as_of), date_policy=date_policy, year=int(str(as_of)[:4]))
    compiled = compile_rules(ctx, flags, phone_region)
    for (name, region_column, default), prefix in ctx.phones.items():
        df = join_plan(df, name, row_region(input_columns, region_column, default), phone_plan, prefix)
    df = ctx.stager.apply(df)
    frame = df.select(*input_columns, *[c for c in (SOURCE,) if c in df.columns], F.col(ROW), *[c.alias(n) for n, c in compiled.masks],
                      *[c.alias(n) for n, c in compiled.dynamic], *[c.alias(n) for n, c in compiled.normalized])
    # The observation doubles as an optimizer barrier: a filter over the results (valid
    # rows, rows with errors) is not pushed below it, so it cannot re-inline the staged
    # check expressions and evaluate them twice.
    frame = frame.observe(f"tabvet_{uuid.uuid4().hex[:12]}", F.count(F.lit(1)).alias("rows"))
    return Validated(frame, rules, input_columns, compiled, overwrite)
