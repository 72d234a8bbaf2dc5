"""Concepts of statement labels: an ordered table of patterns with an issuer's extras, blocks and context names."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.binding import once

_FLOW, _BALANCE = ("ytd", "annual", "balance_sheet_snapshot"), ("balance_sheet_snapshot",)

# Fixed values: (concept, contexts, label patterns, excluded patterns, period types); the first that fits counts.
CONCEPTS = (
    ("revenue", ("profit_or_loss", "segment_note"), ("^revenue$", "^revenues$", r"^sales(?: \(including excise and export tariffs\))?$", "^sales and other operating revenues(?: on non-banking activities, net)?$", "^total sales(?: in the consolidated(?: interim condensed)? statement of comprehensive income)?$"), (), _FLOW),
    ("operating_profit", ("profit_or_loss",), ("^operating profit(?: on non-banking activities)?$", "^profit from operating activities$"), ("financial result",), _FLOW),
    ("net_income", ("profit_or_loss",), (r"^profit \(loss\) for the period$", "^profit for the period$", "^profit for the year(?: .*)?$"), ("attributable to", "ordinary shareholders", "comprehensive"), _FLOW),
    ("total_assets", ("financial_position", "segment_note"), ("^total assets$", "^total assets in the consolidated(?: interim condensed)? balance sheet$"), (), _BALANCE),
    ("total_equity", ("financial_position",), ("^total equity$",), (), _BALANCE),
    ("current_assets", ("financial_position",), ("^total current assets$",), (), _BALANCE),
    ("current_liabilities", ("financial_position",), ("^total current liabilities$",), (), _BALANCE),
    ("cash_and_equivalents", ("financial_position", "cash_note"), ("^cash and cash equivalents$", "^total cash and cash equivalents$"), (), _BALANCE),
    ("operating_cash_flow", ("cash_flow", "cash_flow_note"), ("^net cash provided by operating activities$", "^net cash from operating activities$"), (), _FLOW),
    ("capex", ("cash_flow", "segment_note"), ("^capital expenditures1?$", "^purchases of property, plant and equipment$"), (), _FLOW),
    ("short_term_borrowings", ("financial_position", "debt_note", "segment_note"), ("^short-term borrowings and current portion of long-term debt$", "^short-term borrowings, promissory notes and current portion of long-term borrowings$"), (), _BALANCE),
    ("long_term_borrowings", ("financial_position", "debt_note", "segment_note"), ("^long-term debt$", "^long-term borrowings$", "^long-term borrowings, promissory notes$"), (), _BALANCE),
    ("total_debt", ("debt_note", "financial_risk_note"), ("^total debt$",), (), _BALANCE),
    ("ebitda", ("profit_or_loss", "segment_note", "financial_risk_note"), ("^ebitda$", "^adjusted ebitda$"), (), _FLOW),
    ("net_interest_income", ("profit_or_loss",), ("^net interest income$", "^чистые? процентные доходы?$"), (), _FLOW),
    ("interest_income", ("profit_or_loss",), ("^interest income$", "^процентные доходы$"), (), _FLOW),
    ("interest_expense", ("profit_or_loss",), ("^interest expenses?$", "^процентные расходы$"), (), _FLOW),
    ("fee_and_commission_income", ("profit_or_loss",), ("^fee and commission income$", "^комиссионные доходы$"), (), _FLOW),
    ("fee_and_commission_expense", ("profit_or_loss",), ("^fee and commission expenses?$", "^комиссионные расходы$"), (), _FLOW),
    ("net_fee_commission_income", ("profit_or_loss",), ("^net fee and commission income$", "^чистые? комиссионные доходы?$"), (), _FLOW),
    ("operating_income", ("profit_or_loss",), ("^operating income$", "^total operating income$", "^итого операционные доходы?$"), (), _FLOW),
    ("net_trading_income", ("profit_or_loss",), ("^net trading income$", "^net gains from trading$", "^чистые доходы от торговых операций$", "^чистые доходы от операций с финансовыми инструментами$"), (), _FLOW),
    ("operating_expenses", ("profit_or_loss",), ("^operating expenses$", "^administrative and other operating expenses$", "^операционные расходы$"), (), _FLOW),
    ("profit_before_tax", ("profit_or_loss",), ("^profit before tax$", "^profit before income tax$", "^прибыль до налогообложения$"), (), _FLOW),
    ("total_liabilities", ("financial_position",), ("^total liabilities$", "^итого обязательств$"), (), _BALANCE),
    ("loans_to_customers", ("financial_position",), ("^loans and advances to customers$", "^loans to customers$", "^кредиты и авансы клиентам$"), (), _BALANCE),
    ("customer_accounts", ("financial_position",), ("^amounts due to customers$", "^customer accounts$", "^due to customers$", "^средства клиентов$"), (), _BALANCE),
)
# An issuer's further label patterns, blocked patterns and names of contexts.
ISSUERS = {
    "LKOH": ({"revenue": (r"^sales \(including excise and export tariffs\)",), "net_income": ("^profit for the year$",)}, {}, {"statement_text": "profit_or_loss"}),
    "TATN": (
        {"revenue": ("^sales and other operating revenues on non-banking activities, net$", "^sales and other operating revenues$"), "operating_profit": ("^operating profit on non-banking activities$",), "total_debt": ("^derived total debt$",)},
        {}, {},
    ),
    "GAZP": (
        {
            "revenue": ("^total sales in the consolidated(?: interim condensed)? statement of comprehensive income$",), "total_assets": ("^total assets in the consolidated(?: interim condensed)? balance sheet$",),
            "short_term_borrowings": ("^short-term borrowings, promissory notes and current portion of long-term borrowings$",), "long_term_borrowings": ("^long-term borrowings, promissory notes$",), "operating_cash_flow": ("^net cash from operating activities$",),
        },
        {"net_income": ("attributable to",), "capex": ("capital expenditures2",)},
        {"segment_information_note": "segment_note", "cash_and_cash_equivalents_note": "cash_note", "net_cash_from_operating_activities_note": "cash_flow_note", "financial_risk_factors_note": "financial_risk_note"},
    ),
}
#: The checks of a candidate, in the order in which the first that fails is its reason.
CHECKS = ("label_match", "statement_context_allowed", "period_type_allowed", "unit_detected", "currency_detected", "source_location_exists")


def _any(patterns) -> str:
    """One pattern for any of patterns.  Where all start at the label's start it does too, so that it's tried there only."""
    if all(p.startswith("^") and "|" not in p for p in patterns):
        return f"^(?:{'|'.join(p[1:] for p in patterns)})"
    return "|".join(f"(?:{p})" for p in patterns)


def _fits(label: Column, patterns) -> Column:
    """Whether a label fits any of patterns; whole labels without a special sign are compared, not searched."""
    whole = [p[1:-1] for p in patterns if re.fullmatch(r"\^[\w ,-]+\$", p)]
    rest = [p for p in patterns if not re.fullmatch(r"\^[\w ,-]+\$", p)]
    tests = [label.isin(*whole)] * bool(whole) + [label.rlike(_any(rest))] * bool(rest)
    return tests[0] | tests[1] if len(tests) == 2 else tests[0] if tests else F.lit(False)


def score_concepts(rows: DataFrame, concepts=CONCEPTS, issuers=ISSUERS) -> DataFrame:
    """rows with concept_code, confidence, is_strong, reason, checks (struct of six booleans) and issuer_rules.

    rows: raw_label, statement_context, period_type, unit_detected, currency_detected, source_location_exists, ticker.  The
    first concept one of whose patterns the label fits is taken; one of its excluded patterns ends the search at 0.
    All six checks give 0.9, else 0.65 and the first that fails as the reason.  A label that fits none has no concept;
    null labels count as empty, null flags and contexts as failed checks.
    """
    label = F.trim(F.regexp_replace(F.lower(F.coalesce("raw_label", F.lit(""))), r"\s+", " "))
    context = F.col("statement_context")
    ticker = F.upper(F.coalesce("ticker", F.lit("")))
    for name, (_, _, contexts) in issuers.items():
        for alias, of in contexts.items():
            context = F.when((ticker == name) & (F.col("statement_context") == alias), of).otherwise(context)
    bound = once(rows.withColumns({"\x01ticker": ticker, "\x01context": context}), "\x01label", label)

    def fits(patterns, at: int, code: str) -> Column:
        test = _fits(F.col("\x01label"), patterns)
        for name, issuer in issuers.items():
            more = issuer[at].get(code)
            test = test | ((F.col("\x01ticker") == name) & _fits(F.col("\x01label"), more)) if more else test
        return test

    found = None
    for code, contexts, patterns, excluded, periods in concepts:
        said = F.struct(F.lit(code).alias("code"), fits(excluded, 1, code).alias("excluded"), F.col("\x01context").isin(*contexts).alias("context"), F.col("period_type").isin(*periods).alias("period"))
        found = F.when(fits(patterns, 0, code), said) if found is None else found.when(fits(patterns, 0, code), said)
    sure = lambda c: F.coalesce(c, F.lit(False))
    out = once(bound, "\x01c", found)
    tests = [F.col("\x01c").isNotNull(), F.col("\x01c.context"), F.col("\x01c.period"), F.col("unit_detected"), F.col("currency_detected"), F.col("source_location_exists")]
    out = out.withColumn("checks", F.struct(*[sure(t).alias(n) for t, n in zip(tests, CHECKS, strict=True)]))
    failed = F.coalesce(*[F.when(~F.col(f"checks.{n}"), n) for n in CHECKS])
    known, barred = F.col("\x01c").isNotNull(), sure(F.col("\x01c.excluded"))
    reason = F.when(~known, "no_concept_label_match").when(barred, "excluded_label_pattern").otherwise(failed)
    strong = known & reason.isNull()
    out = out.withColumns({
        "concept_code": F.col("\x01c.code"), "confidence": F.when(~known | barred, 0.0).when(strong, 0.9).otherwise(0.65), "is_strong": strong, "reason": reason,
        "issuer_rules": F.when(known & F.col("\x01ticker").isin(*issuers), F.col("\x01ticker")),
    })
    return out.drop("\x01label", "\x01ticker", "\x01context", "\x01c")
