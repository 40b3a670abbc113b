"""What a model is given to read: facts, then sections within a budget of characters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rankweave.operators.matching import said, strip

#: Sections in the order in which they are given, with their labels; other labels; characters in all, of facts, of the smallest cut.
ORDER = {"header": "HEADER / CONTACT", "summary": "SUMMARY", "experience": "EXPERIENCE", "education": "EDUCATION", "skills": "SKILLS", "certifications": "CERTIFICATIONS", "projects": "PROJECTS"}
FACTS = "PRE-EXTRACTED FACTS (trust email/phone/years when present; fix name/location if wrong):"
WHOLE, MORE = "### FULL RESUME TEXT", "### ADDITIONAL TEXT"
BUDGET, FACT_CHARS, LEAST_CUT, THIN, LEAST_MORE = 14_000, 2_000, 500, 500, 800


def facts_json(facts: dict[str, Column]) -> Column:
    """The facts that are given, one to a line, as a JSON object cut to 2,000 characters; lists stay on their line."""
    there = lambda c: c.isNotNull() & ~F.to_json(F.struct(c.alias("v"))).isin('{"v":""}', '{"v":[]}')
    value = lambda c: F.regexp_extract(F.to_json(F.struct(c.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)
    lines = F.array_compact(F.array(*(F.when(there(c), F.concat(F.lit(f'  "{k}": '), value(c))) for k, c in facts.items())))
    whole = F.when(F.size(lines) == 0, "{}").otherwise(F.concat(F.lit("{\n"), F.array_join(lines, ",\n"), F.lit("\n}")))
    return F.left(whole, F.lit(FACT_CHARS))


def sectioned(parts: Column, text: Column, facts: dict[str, Column] | None = None, budget: int = BUDGET) -> Column:
    """The prompt of a résumé with these parts (a map from section to body).

    Each section is cut to a third of the budget, 500 characters at least. Sections are added in order until the budget is
    reached. Under 500 characters of them the whole text follows, cut to the budget; under 0.6 of the budget the text does, cut
    to what is left of it, if that is more than 800 characters.
    """
    most = max(LEAST_CUT, budget // 3)
    body = lambda k: strip(F.coalesce(parts[k], F.lit("")))
    blocks = F.array_compact(F.array(*(F.when(body(k) != "", F.concat(F.lit(f"### {label}\n"), F.left(body(k), F.lit(most)))) for k, label in ORDER.items())))
    start = F.struct(F.lit(0).alias("used"), F.array().cast("array<string>").alias("kept"))
    add = lambda s, x: F.when(s["used"] >= budget, s).otherwise(F.struct((s["used"] + F.length(x)).alias("used"), F.concat(s["kept"], F.array(x)).alias("kept")))
    whole = F.coalesce(text, F.lit(""))
    head = F.array(F.lit(FACTS), facts_json(facts), F.lit("")) if facts else F.array().cast("array<string>")

    def told(s: Column) -> Column:
        left = F.lit(budget) - s["used"]
        more = (said(parts["full"]).isNotNull()) & (s["used"] < budget * 0.6) & (left > LEAST_MORE)
        tail = F.when(s["used"] < THIN, F.array(F.lit(WHOLE), F.left(whole, F.lit(budget)))).when(more, F.array(F.lit(MORE), F.left(whole, left))).otherwise(F.array().cast("array<string>"))
        return F.array_join(F.concat(head, s["kept"], tail), "\n\n")

    return F.transform(F.array(F.aggregate(blocks, start, add)), told)[0]
