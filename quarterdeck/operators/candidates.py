"""Candidate facts of extraction engines: decoding, fusion, review, promotion and outcome roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import periods as P

LINE_KINDS = ("statement_line_item", "subtotal", "grand_total")
KEY = ("entity", "period", "metric_code")


def decode_column_block(payloads: DataFrame, block: str) -> DataFrame:
    """Provider JSON {block: {columns: [...], data: [[...], ...]}} as (id, row, cells map) rows; a missing block is an error row."""
    parsed = payloads.select("id", F.from_json(F.get_json_object("payload", f"$.{block}"), "columns array<string>, data array<array<string>>").alias("b"))
    rows = parsed.select("id", F.col("b.columns").alias("columns"), F.posexplode_outer("b.data").alias("row", "cells"))
    names = F.transform("columns", lambda c: F.lower(c))
    return rows.select("id", "row", F.when(F.col("cells").isNotNull(), F.map_from_arrays(names, "cells")).alias("cells"), F.when(F.col("columns").isNull(), F.lit(f"{block} block missing")).alias("error"))


def derive_customer_accounts(facts: DataFrame) -> DataFrame:
    """Retail plus corporate accounts of a (document, period) without a stated total; confidence is 0.9 at most."""
    part = lambda c, of="value": F.max(F.when(F.col("metric_code") == c, F.col(of)))
    retail, corporate = "retail_customer_accounts", "corporate_customer_accounts"
    rows = facts.groupBy("document_id", "period").agg(part(retail).alias("r"), part(corporate).alias("c"), part("customer_accounts").alias("total"), F.least(part(retail, "confidence"), part(corporate, "confidence"), F.lit(0.9)).alias("confidence"))
    rows = rows.where(F.col("total").isNull() & F.col("r").isNotNull() & F.col("c").isNotNull())
    return rows.select("document_id", "period", F.lit("customer_accounts").alias("metric_code"), (F.col("r") + F.col("c")).alias("value"), "confidence")


def conflict_reason(a: Column, b: Column) -> Column:
    """Why two candidates of a row don't merge, null if they do; the same whichever of them comes first.

    a, b: structs of label_text, current_value, statement_family, effective_period, sign_hint, page and row_kind.
    """
    differ = lambda c: a[c] != b[c]  # noqa: E731  null where either is
    reason = F.when(differ("statement_family"), "statement_family_conflict").when(differ("effective_period"), "period_conflict").when(differ("sign_hint"), "sign_conflict").when(differ("page"), "page_relation_conflict").when(differ("row_kind"), "row_alignment_conflict")
    odd = lambda x: ~F.coalesce(x["row_kind"], F.lit(LINE_KINDS[0])).isin(*LINE_KINDS)
    empty = F.coalesce(a["label_text"], b["label_text"]).isNull() | F.coalesce(a["current_value"], b["current_value"]).isNull()
    return reason.when(odd(a) | odd(b) | F.coalesce(differ("label_text"), F.lit(False)) | F.coalesce(differ("current_value"), F.lit(False)) | empty, "weak_alignment")


def fuse_candidates(candidates: DataFrame, priority: dict[str, int]) -> DataFrame:
    """The two best candidates of a row, by engine priority and confidence, merged or kept apart with the reason.

    candidates: entity, period, metric_code, engine, label_text, current_value, statement_family, effective_period,
    sign_hint, page, row_kind, confidence.
    """
    order = F.lit(0)
    for engine, n in priority.items():
        order = F.when(F.col("engine") == engine, n).otherwise(order)
    fields = ("engine", "label_text", "current_value", "statement_family", "effective_period", "sign_hint", "page", "row_kind", "confidence")
    place = F.row_number().over(Window.partitionBy(*KEY).orderBy(F.desc(order), F.desc("confidence"), "engine"))
    ranked = candidates.withColumn("place", place).withColumn("x", F.struct(*fields))
    rows = ranked.groupBy(*KEY).agg(F.first(F.when(F.col("place") == 1, F.col("x")), True).alias("a"), F.first(F.when(F.col("place") == 2, F.col("x")), True).alias("b"), F.array_join(F.array_sort(F.collect_set("engine")), ",").alias("engines"), F.bool_and(F.col("engine").contains("ocr")).alias("ocr"))
    reason = F.when(F.col("b").isNotNull(), conflict_reason(F.col("a"), F.col("b")))
    status = F.when(F.col("b").isNull(), "single_engine").when(reason.isNull(), "merged_engines").otherwise("conflict_retained_as_evidence")
    merged = lambda c: F.when(status != "conflict_retained_as_evidence", F.coalesce(f"a.{c}", f"b.{c}"))
    return rows.select(*KEY, status.alias("fusion_status"), reason.alias("reason"), "engines", merged("current_value").alias("value"), merged("label_text").alias("label_text"), F.when(status != "conflict_retained_as_evidence", F.greatest("a.confidence", "b.confidence")).alias("confidence"), F.when(F.col("ocr"), "ocr_only_lower_trust").alias("warning"))


def engine_contribution(fused: DataFrame) -> DataFrame:
    """Per engine: items it took part in, those merged, single and kept as conflicts, and those that only optical engines saw."""
    status = lambda s: F.count_if(F.col("fusion_status") == s)
    rows = fused.select(F.split("engines", ",").alias("all"), "fusion_status").withColumn("optical", F.forall("all", lambda e: e.contains("ocr")))
    return rows.select(F.explode("all").alias("engine"), "fusion_status", "optical").groupBy("engine").agg(
        F.count(F.lit(1)).alias("items"), status("merged_engines").alias("merged"), status("single_engine").alias("single"), status("conflict_retained_as_evidence").alias("conflicts"), F.count_if("optical").alias("ocr_only")
    )


def review_candidates(candidates: DataFrame) -> DataFrame:
    """blocked without a value, needs_manual_check without a trace, else eligible."""
    return candidates.withColumn("review_status", F.when(F.col("value").isNull(), "blocked").when(F.coalesce("trace", F.lit("")) == "", "needs_manual_check").otherwise("eligible"))


def review_counts(reviewed: DataFrame) -> DataFrame:
    return reviewed.groupBy("entity").agg(*[F.count_if(F.col("review_status") == s).alias(s) for s in ("eligible", "needs_manual_check", "blocked")])


def promote_reviewed(existing: DataFrame, reviewed: DataFrame, codes: list[str] | None = None) -> DataFrame:
    """What becomes of each reviewed candidate: promoted, skipped for a foreign row of its key, or blocked.

    codes: metrics to promote; eligible candidates of others are skipped (None or empty: all).
    """
    foreign = existing.where(F.col("provenance") != "reviewed_manual_upload").select(*KEY, F.lit(True).alias("foreign"))
    rows = reviewed.join(foreign, [*KEY], "left")
    action = F.when(F.col("review_status") != "eligible", "blocked").when(F.col("foreign"), "skipped")
    if codes:
        action = action.when(~F.coalesce(F.col("metric_code").isin(*codes), F.lit(False)), "skipped")
    action = action.otherwise("promoted")
    done = action == "promoted"
    return rows.select(*KEY, "value", action.alias("action"), F.when(done, "reviewed_manual_upload").alias("quality_flag"), F.when(done, 0.95).alias("confidence"))


def promoted_table(existing: DataFrame, promoted: DataFrame) -> DataFrame:
    """The facts after promote_reviewed: promoted rows in place of those of their key, all others as they were.

    existing: entity, period, metric_code, value, quality_flag, confidence, provenance; one row a key.  New rows are of
    provenance reviewed_manual_upload; keys with a null stay apart, since null matches nothing.
    """
    new = promoted.where(F.col("action") == "promoted").select(*KEY, F.struct("value", "quality_flag", "confidence", F.lit("reviewed_manual_upload").alias("provenance")).alias("new"))
    old = existing.select(*KEY, F.struct("value", "quality_flag", "confidence", "provenance").alias("old"))
    rows = old.hint("merge").join(new.hint("merge"), [*KEY], "full_outer")
    return rows.select(*KEY, F.coalesce("new", "old").alias("row")).select(*KEY, "row.*")


def promotion_counts(promoted: DataFrame) -> DataFrame:
    """entity, promoted, skipped and blocked candidates of promote_reviewed."""
    return promoted.groupBy("entity").agg(*[F.count_if(F.col("action") == a).alias(a) for a in ("promoted", "skipped", "blocked")])


def rejection_counts(rejected: DataFrame) -> DataFrame:
    """Reasons, trimmed and lower-cased with underscores, and their counts; rejected: reasons (comma-separated)."""
    reason = F.regexp_replace(F.lower(F.trim("reason")), r"[\s-]+", "_")
    return rejected.select(F.explode(F.split("reasons", ",")).alias("reason")).where(F.trim("reason") != "").groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("rows"))


def statement_coverage(tables: DataFrame, required=("balance_sheet", "income_statement", "cash_flow")) -> DataFrame:
    """Per entity and required family: found, tables, sorted periods."""
    grid = tables.select("entity").distinct().select("entity", F.explode(F.array(*map(F.lit, required))).alias("family"))
    seen = tables.groupBy("entity", F.col("statement_type").alias("family")).agg(F.count(F.lit(1)).alias("tables"), F.array_join(F.array_sort(F.collect_set("period")), ",").alias("periods"))
    rows = grid.join(seen.hint("merge"), ["entity", "family"], "left")
    return rows.select("entity", "family", F.col("tables").isNotNull().alias("found"), F.coalesce("tables", F.lit(0).cast("long")).alias("tables"), F.coalesce("periods", F.lit("")).alias("periods"))


def family_completeness(coverage: DataFrame, facts: DataFrame) -> DataFrame:
    """Rows of statement_coverage with facts, key_facts (sorted array of their metrics) and status: complete, detected_without_facts, missing.

    facts: entity, statement_type, metric_code.  Facts of a family without a table leave it missing.
    """
    found = facts.groupBy("entity", F.col("statement_type").alias("family")).agg(F.count(F.lit(1)).alias("facts"), F.array_sort(F.collect_set("metric_code")).alias("key_facts"))
    rows = coverage.hint("merge").join(found.hint("merge"), ["entity", "family"], "left")
    rows = rows.withColumns({"facts": F.coalesce("facts", F.lit(0).cast("long")), "key_facts": F.coalesce("key_facts", F.array().cast("array<string>"))})
    return rows.withColumn("status", F.when(~F.col("found"), "missing").when(F.col("facts") > 0, "complete").otherwise("detected_without_facts"))


def missing_families(coverage: DataFrame) -> DataFrame:
    """entity, required_found and missing (sorted array) of the families of statement_coverage."""
    gone = F.array_sort(F.collect_set(F.when(~F.col("found"), F.col("family"))))
    return coverage.groupBy("entity").agg(F.bool_and("found").alias("required_found"), gone.alias("missing"))


def period_resolution(documents: DataFrame, tables: DataFrame) -> DataFrame:
    """document_id, effective_period, comparative_period, period_source and period_confidence: those of its surest table.

    documents: document_id, period (the one it was uploaded for); tables: document_id, table_id, effective_period,
    comparative_period, period_source, period_confidence.  Ties go to the smallest table_id; a null confidence counts as 0.  Without
    a table that has a period, the document's own stands, at a confidence of 0.1.
    """
    sure = F.coalesce(F.col("period_confidence").cast("double"), F.lit(0.0))
    cell = F.struct(F.col("effective_period").alias("e"), F.col("comparative_period").alias("c"), F.col("period_source").alias("s"), sure.alias("q"))
    best = tables.where(F.col("effective_period").isNotNull()).groupBy("document_id").agg(F.min_by(cell, F.struct(-sure, F.col("table_id"))).alias("b"))
    rows = documents.select("document_id", "period").hint("merge").join(best.hint("merge"), "document_id", "left")
    return rows.select(
        "document_id", F.coalesce("b.e", "period").alias("effective_period"), F.col("b.c").alias("comparative_period"),
        F.when(F.col("b").isNull(), "upload_default").otherwise(F.col("b.s")).alias("period_source"), F.coalesce("b.q", F.lit(0.1)).alias("period_confidence"),
    )


def document_final_status(counts: DataFrame) -> DataFrame:
    """FULL, PARTIAL, EVIDENCE_ONLY or BLOCKED from (document_id, facts, rejected, evidence)."""
    status = F.when((F.col("facts") > 0) & (F.col("rejected") + F.col("evidence") == 0), "FULL").when(F.col("facts") > 0, "PARTIAL").when(F.col("evidence") > 0, "EVIDENCE_ONLY").otherwise("BLOCKED")
    action = F.when(status == "FULL", "none").when(status == "PARTIAL", "review_leftovers").when(status == "EVIDENCE_ONLY", "promote_evidence").otherwise("upload_better_source")
    return counts.withColumn("status", status).withColumn("next_action", action)


def missing_breakdown(audited: DataFrame) -> DataFrame:
    """Missing metrics by cause."""
    code = F.col("metric_code")
    cause = F.when(code.isin("pe_ratio", "ev_to_ebitda", "dividend_yield"), "requires_market_inputs").when(code.isin("ebitda_margin", "net_debt_to_ebitda"), "requires_explicit_disclosure").when(code.isin("roe", "roa"), "blocked_by_period_semantics").when(code.isin("net_interest_margin", "cost_to_income", "loan_to_deposit", "equity_to_assets", "net_margin_like"), "unavailable_in_source").otherwise("fixable_by_parser")
    return audited.where(F.col("status") == "missing").groupBy(cause.alias("cause")).agg(F.count(F.lit(1)).alias("rows"), F.array_join(F.array_sort(F.collect_set("metric_code")), ",").alias("metrics"))


def support_blockers(items: DataFrame, top: int = 10) -> DataFrame:
    """The top blockers of all entities by number of entities, then name; items: entity, blockers (array).  Repeats in a row count once."""
    rows = items.select("entity", F.explode(F.array_distinct("blockers")).alias("blocker"))
    return rows.groupBy("blocker").agg(F.count_distinct("entity").alias("entities")).orderBy(F.desc("entities"), "blocker").limit(top)


def support_scan(statuses: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """Counts over a fixed list of states; unknown states count as the last, zeros stay."""
    known = F.when(F.col("status").isin(*names), F.col("status")).otherwise(names[-1])
    dim = statuses.sparkSession.createDataFrame([(n,) for n in names], "status string")
    counts = statuses.groupBy(known.alias("status")).agg(F.count(F.lit(1)).alias("n"))
    return dim.join(counts, "status", "left").select("status", F.coalesce("n", F.lit(0).cast("long")).alias("entities"))


#: Roles of sources that a quarter is ready with, and all that are counted.
PROPER_ROLES = ("financial_statements", "financial_supplement", "annual_report")
SOURCE_ROLES = (*PROPER_ROLES, "press_release")


def _asked(entities: DataFrame, period_from: str, period_to: str) -> DataFrame:
    """Every entity and every quarter of the range."""
    first, last = P.range_bounds(period_from, period_to)
    rows = entities.select("entity").distinct().select("entity", F.explode(F.sequence(F.lit(first), F.lit(last))).alias("i"))
    return rows.select("entity", P.period_from_index(F.col("i")).alias("period"))


def source_package(entities: DataFrame, sources: DataFrame, period_from: str, period_to: str) -> DataFrame:
    """entity, period, sources, has_ and verified_ flags of each proper role, press_only and readiness: a row for every quarter of
    the range.

    entities: entity; sources: entity, period, source_role, verified.  A quarter with a proper role is ready, with
    other sources partial, without any missing.  Sources of other entities and quarters are left out.
    """
    role, sure = F.col("source_role"), F.coalesce("verified", F.lit(False))
    has = [F.bool_or(F.coalesce(role == r, F.lit(False))).alias(f"has_{r}") for r in PROPER_ROLES]
    verified = [F.bool_or(F.coalesce(role == r, F.lit(False)) & sure).alias(f"verified_{r}") for r in PROPER_ROLES]
    counts = [F.count_if(role == r).alias(f"n_{r}") for r in SOURCE_ROLES]
    found = sources.groupBy("entity", "period").agg(F.count(F.lit(1)).alias("sources"), *has, *verified, *counts)
    rows = _asked(entities, period_from, period_to).hint("merge").join(found.hint("merge"), ["entity", "period"], "left")
    flags = [f"{k}_{r}" for k in ("has", "verified") for r in PROPER_ROLES]
    rows = rows.withColumns({f: F.coalesce(f, F.lit(False)) for f in flags} | {c: F.coalesce(c, F.lit(0).cast("long")) for c in ("sources", *[f"n_{r}" for r in SOURCE_ROLES])})
    proper = F.col(flags[0]) | F.col(flags[1]) | F.col(flags[2])
    press = (F.col("sources") > 0) & (F.col("sources") == F.col("n_press_release"))
    return rows.withColumns({"press_only": press, "readiness": F.when(proper, "ready").when(F.col("sources") > 0, "partial").otherwise("missing")})


def package_summary(periods: DataFrame, *, verified: bool = False) -> DataFrame:
    """A row an entity of source_package: quarters by role, role counts, missing quarters and the package's status.

    verified: only verified sources make a package; READY if the quarters of its proper roles are as many as all.
    """
    with_role = lambda k, r: F.count_if(f"{k}_{r}").alias(f"periods_{k}_{r}")
    rows = periods.groupBy("entity").agg(
        F.count(F.lit(1)).alias("periods"), *[with_role(k, r) for k in ("has", "verified") for r in PROPER_ROLES], F.count_if("press_only").alias("periods_press_only"), *[F.sum(f"n_{r}").alias(f"n_{r}") for r in SOURCE_ROLES],
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("readiness") == "missing", F.col("period")))), ",").alias("missing_periods"),
    )
    kind = "verified" if verified else "has"
    proper = F.col(f"periods_{kind}_{PROPER_ROLES[0]}") + F.col(f"periods_{kind}_{PROPER_ROLES[1]}") + F.col(f"periods_{kind}_{PROPER_ROLES[2]}")
    return rows.withColumn("status", F.when(proper >= F.col("periods"), "READY").when(proper > 0, "PARTIAL").otherwise("NOT_READY"))


def report_candidates(candidates: DataFrame, period_from: str, period_to: str) -> DataFrame:
    """Candidates of the range, the best of each (entity, period, url) by confidence, then document; nulls come last."""
    place = F.row_number().over(Window.partitionBy("entity", "period", "url").orderBy(F.desc_nulls_last("confidence"), "document_id"))
    return candidates.where(F.col("period").between(period_from, period_to)).withColumn("place", place).where("place = 1").drop("place")


def discovery_status(entities: DataFrame, best: DataFrame, period_from: str, period_to: str) -> DataFrame:
    """entity, reports, missing_periods and status of report_candidates: READY if statements cover every quarter of the range,
    PARTIAL with some candidate, else NOT_FOUND."""
    covered = best.where(F.col("source_role") == "financial_statements").select("entity", "period").distinct().withColumn("covered", F.lit(True))
    grid = _asked(entities, period_from, period_to).hint("merge").join(covered.hint("merge"), ["entity", "period"], "left")
    gaps = grid.groupBy("entity").agg(F.array_join(F.array_sort(F.collect_list(F.when(F.col("covered").isNull(), F.col("period")))), ",").alias("missing_periods"))
    counts = best.groupBy("entity").agg(F.count(F.lit(1)).alias("reports"))
    rows = gaps.hint("merge").join(counts.hint("merge"), "entity", "left").withColumn("reports", F.coalesce("reports", F.lit(0).cast("long")))
    return rows.withColumn("status", F.when(F.col("reports") == 0, "NOT_FOUND").when(F.col("missing_periods") == "", "READY").otherwise("PARTIAL"))


def rank_providers(providers: DataFrame) -> DataFrame:
    """Providers of each data type by trust, then access, then name; providers: provider, data_types (array), trust, access."""
    rank = lambda c, best: F.when(F.col(c) == best[0], 0).when(F.col(c) == best[1], 1).otherwise(2)
    order = [rank("trust", ("high", "medium")), rank("access", ("open", "key")), F.col("provider")]
    rows = providers.select("provider", "trust", "access", F.explode("data_types").alias("data_type"))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("data_type").orderBy(*order)))
