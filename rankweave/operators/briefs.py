"""What a brief asks for: a checklist of its contents, its points, and which of them a document meets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rankweave.functions.text import tokens
from rankweave.operators.profile import distinct_words

# Fixed values.
CHECKS = {
    "years_or_seniority": r"(?i)\b(\d+\+?\s*years?|senior|junior|mid[- ]?level|entry[- ]?level|fresher|intern|lead|principal|manager)\b",
    "location": r"(?i)\b(location|based in|remote|hybrid|onsite|on-site|relocat|bangalore|bengaluru|mumbai|delhi|hyderabad|chennai|pune|noida|gurgaon|kolkata|india|usa|uk|city)\b",
    "must_haves": r"(?i)\b(must|required|mandatory|need|essential|critical|should have|looking for)\b",
    "skills_or_tools": r"(?i)\b(skill|experience with|proficient|knowledge of|tools?|software|platform|crm|erp|excel|sap|salesforce|python|java|nursing|sales|marketing|accounting|warehouse|license)\b",
    "education_or_license": r"(?i)\b(degree|b\.?tech|mba|b\.?sc|m\.?sc|diploma|graduate|license|licence|certified|certification|rn|ca|cpa)\b",
}
BULLET = r"^(?:[-*•]|\d+[.)])\s+(.+)$"
LISTED = r"(?i)(?:must(?:-have)?s?|required|need(?:s)?|looking for)\s*[:\-]\s*(.+)"


def checklist(text: Column) -> dict[str, Column]:
    """A boolean per check, score (0 to 100 in steps of 20, at most 40 for briefs under 80 characters) and ready."""
    found = {k: text.rlike(p) for k, p in CHECKS.items()}
    n = sum((c.cast("long") for c in found.values()), F.lit(0).cast("long"))
    long = F.length(F.trim(text)) >= 80
    score = F.when(long, n * 20).otherwise(F.least(n * 20, F.lit(40).cast("long")))
    return found | {"score": score, "ready": long & (n >= 3)}


def points(text: Column, most: int = 12) -> Column:
    """Bullets, listed requirements and, if these are fewer than four, long words; without repeats."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(x))
    bullets = F.filter(F.transform(lines, lambda x: F.trim(F.regexp_extract(x, BULLET, 1))), lambda x: F.length(x).between(4, 120))
    chunks = F.regexp_extract_all(text, F.lit(LISTED), F.lit(1))
    parts = F.flatten(F.transform(chunks, lambda x: F.transform(F.split(x, "[,;]| and "), lambda p: F.regexp_replace(p, r"^[ .]+|[ .]+$", ""))))
    found = F.concat(bullets, F.filter(parts, lambda x: F.length(x).between(3, 80)))
    words = F.filter(F.slice(F.array_distinct(tokens(text)), 1, most), lambda x: F.length(x) >= 4)
    return F.slice(distinct_words(F.when(F.size(found) < 4, F.concat(found, words)).otherwise(found)), 1, most)


def met(points_: Column, text: Column) -> Column:
    """The points of which 60 % of the words (all of it, where it has no word) occur in the text."""
    low = F.lower(text)

    def one(point: Column) -> Column:
        words = tokens(point)
        hit = F.size(F.filter(words, lambda w: low.contains(w)))
        return F.when(F.size(words) == 0, low.contains(F.lower(point))).otherwise(hit >= F.ceil(F.size(words) * 0.6))

    return F.filter(points_, one)
