"""Finding and masking personal data."""

from __future__ import annotations

import base64
import json
import os
import re
import warnings
from pathlib import Path
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anchorline.functions.checks import col, columns, frame, one_of
from anchorline.functions.order import with_position
from anchorline.functions.patterns import java_pattern
from anchorline.functions.types import is_text
from anchorline.session import get_spark, join_small, materialize


class PIIWarning(UserWarning):
    """A frame may hold personal data."""


class MappingSecurityWarning(UserWarning):
    """A mapping is stored without encryption."""


# Kind -> (pattern of values or None, pattern of column names, description, label).
PATTERNS: dict[str, tuple[str | None, str, str, str]] = {
    "email": (r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}", r"(?i)(e[\-_]?mail|email[\-_]?addr)", "Email address", "EMAIL"),
    "phone_us": (r"(?:\+?1[\-.\s]?)?\(?\d{3}\)?[\-.\s]?\d{3}[\-.\s]?\d{4}", r"(?i)(phone|tel|mobile|cell|fax)", "US phone number", "PHONE"),
    "phone_intl": (r"\+\d{1,3}[\-.\s]?\d{4,14}", r"(?i)(phone|tel|mobile|cell)", "International phone number", "PHONE"),
    "ssn": (r"\b\d{3}[\-\s]?\d{2}[\-\s]?\d{4}\b", r"(?i)(ssn|social[\-_\s]?sec|tax[\-_\s]?id)", "US Social Security Number", "SSN"),
    "credit_card": (r"\b(?:4\d{3}|5[1-5]\d{2}|3[47]\d{2}|6(?:011|5\d{2}))[- ]?\d{4}[- ]?\d{4}[- ]?\d{3,4}\b", r"(?i)(credit[\-_\s]?card|cc[\-_\s]?num|card[\-_\s]?num|pan)", "Credit card number", "CARD"),
    "ip_address": (r"\b(?:\d{1,3}\.){3}\d{1,3}\b", r"(?i)(ip[\-_\s]?addr|ip[\-_\s]?address|client[\-_\s]?ip|src[\-_\s]?ip)", "IPv4 address", "IP"),
    "aadhaar": (r"\b\d{4}[\-\s]?\d{4}[\-\s]?\d{4}\b", r"(?i)(aadhaar|aadhar|uid)", "Indian Aadhaar number", "UID"),
    "iban": (r"\b[A-Z]{2}\d{2}[A-Z0-9]{4,30}\b", r"(?i)(iban|bank[\-_\s]?acct|account[\-_\s]?num)", "International Bank Account Number (IBAN)", "IBAN"),
    "date_of_birth": (None, r"(?i)(dob|date[\-_\s]?of[\-_\s]?birth|birth[\-_\s]?date|birthday)", "Date of birth", "DOB"),
    "passport": (r"\b[A-Z]{1,2}\d{6,9}\b", r"(?i)(passport[\-_\s]?num|passport[\-_\s]?no|passport[\-_\s]?id)", "Passport number", "PASSPORT"),
    "name_field": (None, r"(?i)^(first[\-_\s]?name|last[\-_\s]?name|full[\-_\s]?name|surname|given[\-_\s]?name|family[\-_\s]?name)$", "Person name field", "PERSON"),
    "address": (None, r"(?i)(street[\-_\s]?addr|address[\-_\s]?line|postal[\-_\s]?addr|home[\-_\s]?addr|mailing[\-_\s]?addr)", "Physical address", "ADDRESS"),
    "routing_number": (r"\b0[0-9]{2}[0-9]{6}\b|\b[123678][0-9]{8}\b", r"(?i)(routing[\-_\s]?num|aba[\-_\s]?routing|rtn|transit[\-_\s]?num)", "US ABA bank routing number", "ROUTING"),
    "account_number": (r"\b\d{6,17}\b", r"(?i)(acct[\-_\s]?num|account[\-_\s]?number|bank[\-_\s]?account|deposit[\-_\s]?acct|checking[\-_\s]?acct|savings[\-_\s]?acct)", "Bank account number", "ACCOUNT"),
    "swift_bic": (r"\b[A-Z]{4}[A-Z]{2}[A-Z2-9][A-NP-Z0-9]([A-Z0-9]{3})?\b", r"(?i)(swift|bic[\-_\s]?code|swift[\-_\s]?code|bank[\-_\s]?id[\-_\s]?code)", "SWIFT/BIC bank identifier code", "SWIFT"),
    "pan_masked": (r"\b[*Xx\d]{4}[\-\s]?[*Xx\d]{4}[\-\s]?[*Xx\d]{4}[\-\s]?\d{4}\b", r"(?i)(masked[\-_\s]?pan|pan[\-_\s]?mask|card[\-_\s]?mask|last[\-_\s]?4)", "Masked payment card number (PCI-DSS)", "PAN"),
    "sort_code": (r"\b\d{2}[\-]\d{2}[\-]\d{2}\b", r"(?i)(sort[\-_\s]?code|sort[\-_\s]?num|uk[\-_\s]?sort)", "UK bank sort code", "SORT"),
    "bsb_number": (r"\b\d{3}[\-]\d{3}\b", r"(?i)(bsb[\-_\s]?num|bsb[\-_\s]?code|au[\-_\s]?bsb)", "Australian BSB (Bank State Branch) code", "BSB"),
    "tax_id_ein": (r"\b\d{2}[\-]\d{7}\b", r"(?i)(ein|employer[\-_\s]?id|tax[\-_\s]?id[\-_\s]?num|tin[\-_\s]?num|federal[\-_\s]?tax)", "US Employer Identification Number (EIN/TIN)", "EIN"),
    "internal_cust_id": (None, r"(?i)(cust[\-_\s]?id|customer[\-_\s]?id|client[\-_\s]?id|cif[\-_\s]?num|party[\-_\s]?id|member[\-_\s]?id|account[\-_\s]?holder[\-_\s]?id)", "Internal customer / CIF identifier", "CUST"),
}
LEVELS = {"low": 0, "medium": 1, "high": 2}
REPORT = "Column string, PII_Type string, Detection_Method string, Confidence string, Sample_Match string, Description string"


class Pseudonyms(NamedTuple):
    """The masked frame and its mapping: column, value, pseudonym."""

    df: DataFrame
    mapping: DataFrame


def scan_pii(df: DataFrame, patterns: dict | None = None, sample_size: int = 100, warn: bool = True, full_scan: bool = False, counts: bool = False) -> DataFrame:
    """Columns that may hold personal data: by name (high), or by the share of the first `sample_size` non-null texts that match (over half high, over
    a tenth medium, else low).

    `patterns` replaces the built-in kinds: {kind: (value pattern or None, name pattern or None, description, label)} or dicts with value_regex, name_regex, description. All
    patterns of a column are counted in one aggregate. `full_scan` counts over all rows. `counts` adds Matches and Texts, the non-null texts that match and all
    that were looked at (null for findings by name).
    """
    frame(df)
    kinds = {k: (p.get("value_regex"), p.get("name_regex"), p.get("description", k), k.upper()) if isinstance(p, dict) else p for k, p in (patterns or PATTERNS).items()}
    rows = []
    for f in df.schema:
        c = col(f.name)
        by_name = [k for k, p in kinds.items() if p[1] and re.search(p[1], f.name)]
        rows += [(f.name, k, "column_name", "high", None, kinds[k][2], None, None) for k in by_name]
        values = [k for k, p in kinds.items() if p[0] and k not in by_name]
        if not is_text(f.dataType) or not values:
            continue
        texts = df.select(c.alias("v")).filter("v is not null")
        texts = texts if full_scan else texts.limit(sample_size)
        aggs = [F.count(F.lit(1)).alias("n")]
        for i, k in enumerate(values):
            hit = F.col("v").rlike(java_pattern(kinds[k][0]).removeprefix("(?U)"))
            aggs += [F.count_if(hit).alias(f"k{i}"), F.min(F.when(hit, F.col("v"))).alias(f"m{i}")]
        row = texts.agg(*aggs).first()
        for i, k in enumerate(values):
            if row[f"k{i}"]:
                share = row[f"k{i}"] / row["n"]
                rows.append((f.name, k, "value_regex", "high" if share > 0.5 else "medium" if share > 0.1 else "low", row[f"m{i}"], kinds[k][2], row[f"k{i}"], row["n"]))
    if rows and warn:
        warnings.warn(f"possible personal data in: {', '.join(dict.fromkeys(r[0] for r in rows))}", PIIWarning, stacklevel=2)
    found = df.sparkSession.createDataFrame(rows, f"{REPORT}, Matches bigint, Texts bigint")
    return found if counts else found.drop("Matches", "Texts")


def mask_pii(df: DataFrame, report: DataFrame | None = None, strategy: str = "redact", redact_value: str = "[REDACTED]", hash_length: int = 12, min_confidence: str = "low", columns_to_mask: list[str] | None = None) -> DataFrame | Pseudonyms:
    """Mask the columns of a scan report, or `columns_to_mask`.

    redact: a fixed text in all rows; hash: the first hex digits of SHA-256, null stays null; pseudonymise: LABEL_1, LABEL_2, ... in the order of first appearance, and
    the mapping, both as frames.
    """
    frame(df)
    one_of(strategy, ("redact", "hash", "pseudonymise"), "strategy")
    one_of(min_confidence, LEVELS, "min_confidence")
    if columns_to_mask is not None:
        names = columns(df, columns_to_mask)
        kind: dict[str, str] = {}
    elif report is not None:
        found = [r for r in report.collect() if LEVELS[r["Confidence"]] >= LEVELS[min_confidence] and r["Column"] in df.columns]  # at most columns x kinds
        names = list(dict.fromkeys(r["Column"] for r in found))
        kind = {}
        for r in sorted(found, key=lambda r: -LEVELS[r["Confidence"]]):
            kind.setdefault(r["Column"], r["PII_Type"])
    else:
        raise ValueError("mask_pii needs a report or columns")
    if strategy != "pseudonymise":
        make = (lambda n: F.lit(redact_value)) if strategy == "redact" else (lambda n: F.substring(F.sha2(col(n).cast("string"), 256), 1, hash_length))
        return df.select(*[make(c).alias(c) if c in names else col(c) for c in df.columns])
    out, mapping = df, None
    for n in names:
        label = PATTERNS[kind[n]][3] if kind.get(n) in PATTERNS else re.sub(r"\W+", "_", n).upper()
        first = df.select(col(n).cast("string").alias("value"), F.monotonically_increasing_id().alias("at")).filter("value is not null").groupBy("value").agg(F.min("at").alias("at"))
        numbered = with_position(first, "i", 1, "at").select(F.lit(n).alias("column"), "value", F.concat(F.lit(f"{label}_"), F.col("i").cast("string")).alias("pseudonym"))
        numbered = materialize(numbered, "pseudonyms")
        book = numbered.select(F.col("value").alias("_value"), F.col("pseudonym").alias("_new"))
        joined = join_small(out.withColumn("_value", col(n).cast("string")), book, "_value", "left")
        out = joined.select(*[F.col("_new").alias(c) if c == n else col(c) for c in df.columns])
        mapping = numbered if mapping is None else mapping.unionByName(numbered)
    return Pseudonyms(out, mapping if mapping is not None else get_spark().createDataFrame([], "column string, value string, pseudonym string"))


ITERATIONS = 480_000


def _key(password: str, salt: bytes) -> bytes:
    import hashlib

    return hashlib.pbkdf2_hmac("sha256", password.encode(), salt, ITERATIONS, 32)


def _cipher(key: bytes):
    try:
        from cryptography.hazmat.primitives.ciphers.aead import AESGCM
    except ImportError as e:
        raise ImportError("encrypted mappings need the package cryptography") from e
    return AESGCM(key)


def save_mapping(mapping: DataFrame | dict, path: str, encryption_key: str | None = None, most: int = 1_000_000) -> None:
    """Store a mapping as JSON, encrypted (AES-256-GCM, key by PBKDF2) if a key is given, else with a warning. At most `most` entries; larger ones are written as a table."""
    if isinstance(mapping, DataFrame):
        rows = mapping.limit(most + 1).collect()
        if len(rows) > most:
            raise ValueError(f"more than {most} entries; write the mapping as a table")
        data: dict = {}
        for r in rows:
            data.setdefault(r["column"], {})[r["value"]] = r["pseudonym"]
    else:
        data = mapping
    text = json.dumps(data, ensure_ascii=False, indent=None if encryption_key else 2).encode()
    if encryption_key:
        salt, nonce = os.urandom(16), os.urandom(12)
        text = base64.b64encode(salt + nonce + _cipher(_key(encryption_key, salt)).encrypt(nonce, text, None))
    else:
        warnings.warn("the mapping is stored without encryption", MappingSecurityWarning, stacklevel=2)
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_bytes(text)


def load_mapping(path: str, encryption_key: str | None = None) -> dict:
    """A stored mapping; ValueError for a wrong key or a file that is no mapping."""
    if not Path(path).exists():
        raise FileNotFoundError(path)
    text = Path(path).read_bytes()
    if encryption_key:
        cipher = None
        try:
            raw = base64.b64decode(text, validate=True)
            cipher = _cipher(_key(encryption_key, raw[:16]))
            text = cipher.decrypt(raw[16:28], raw[28:], None)
        except ImportError:
            raise
        except Exception as e:
            raise ValueError("wrong key, or no encrypted mapping") from e
    try:
        return json.loads(text)
    except ValueError as e:
        raise ValueError("no mapping, or an encrypted one") from e
