"""Text functions as expressions inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and keywords of the text functions.
PII = (
    (r"\b\d{3}-\d{2}-\d{4}\b", "[SSN REDACTED]"),
    (r"\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b", "[PHONE REDACTED]"),
    (r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", "[EMAIL REDACTED]"),
)
TOPICS = {
    "RISK:CYBER": ("cybersecurity", "data breach", "ransomware", "hacking", "cyber attack"),
    "RISK:CLIMATE": ("climate change", "carbon", "sustainability", "emissions", "environmental"),
    "RISK:SUPPLY": ("supply chain", "logistics", "shortage", "disruption"),
    "RISK:REGULATORY": ("compliance", "regulation", "sec", "enforcement"),
    "TOPIC:AI": ("artificial intelligence", "machine learning", "neural network"),
    "TOPIC:CLOUD": ("cloud computing", "aws", "azure", "saas"),
    "TOPIC:FINANCIAL": ("revenue", "net income", "assets", "liabilities", "cash flow"),
}


def scrub_pii(text: Column) -> Column:
    """Social security and phone numbers and addresses of e-mail, each replaced by a mark, in that order."""
    for pattern, mark in PII:
        text = F.regexp_replace(text, pattern, mark)
    return text


def extract_topics(text: Column, topics: dict[str, tuple[str, ...]] = TOPICS) -> Column:
    """Topics with a keyword in the text in lower case, in the order of the map."""
    low = F.lower(text)
    found = [F.when(low.rlike("|".join(map(quoted, words))), F.lit(topic)) for topic, words in topics.items()]
    return F.when(text.isNotNull(), F.array_compact(F.array(*found)))


def quoted(word: str) -> str:
    return "\\Q" + word + "\\E"


def parse_json(text: Column, language: Column | str | None = None) -> Column:
    """A variant; invalid JSON fails the query, null stays null. There is no language but JSON."""
    return F.parse_json(text)


def json_field(text: Column, path: str, kind: str) -> Column:
    return F.variant_get(F.parse_json(text), path, kind)
