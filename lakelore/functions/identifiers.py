"""Identifiers in texts as columns: checksums, masks, labels."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Patterns by label, in the order in which labels are reported.
TAXPAYER_PATTERNS = (
    ("SSN", r"\b\d{3}[-\s]\d{2}[-\s]\d{4}\b"),
    ("SSN-unformatted", r"(?is)\b(?:SSN|SSNs|social\s+security|TIN|ITIN)\b.{0,40}?\b\d{9}\b"),
    ("EIN", r"\b\d{2}[-\s]\d{7}\b"),
    ("taxpayer+amount", r"(?is)taxpayer.{0,30}\$[\d,]+"),
    ("tax-form+amount", r"(?is)\b(Form\s+)?(1040|1065|1041|1120)[A-Z-]*.{0,50}\$[\d,]+"),
    ("1099+amount", r"(?is)\b1099[-–—\s]{1,3}[A-Z]{1,4}.{0,50}\$[\d,]+"),
    ("W2+amount", r"(?is)\bW\s*[-–—]?\s*2\b.{0,50}\$[\d,]+"),
    ("schedule+amount", r"(?is)\b(?:Schedule|Sch\.?)[-–—\s]+[A-Z]{1,2}\b.{0,50}\$[\d,]+"),
)
IDENTIFYING = ("SSN", "SSN-unformatted", "EIN")
# What a corpus is screened for.
SCREEN_PATTERNS = (
    ("ssn", r"\b(?!000|666|9\d\d)\d{3}-(?!00)\d{2}-(?!0000)\d{4}\b"),
    ("ein", r"\b\d{2}-\d{7}\b"),
    ("bank-account", r"(?i)\b(?:routing|aba|account)\s*(?:number|no\.?|#)?\s*[:#]?\s*\d{6,17}\b"),
    ("tax-form-with-data", r"(?i)\b(?:form\s*)?(?:1040|1120S?|1065|941|940|W-2|1099-[A-Z]{1,4}|K-1)\b"),
    ("client-file-language", r"(?i)\b(?:dear\s+(?:mr|mrs|ms|dr)\b|engagement\s+letter|invoice\s+(?:no|number|#)|taxpayer\s+name)"),
)
# Words that tell a taxpayer's number, and a bare run of its length.
VOCABULARY = r"(?i)\b(ssn|ssns|social\s+security|tin|itin|taxpayer\s+id)\b"
BARE = r"\b\d{9}\b"


def ascii_bounds(pattern: str) -> str:
    """A pattern whose word boundaries know ASCII letters, digits and underscores only, as the patterns mean them: what follows an accented letter is at one."""
    word = "[A-Za-z0-9_]"
    return pattern.replace(r"\b", f"(?:(?<!{word})(?={word})|(?<={word})(?!{word}))")


def luhn(digits: Column) -> Column:
    """Whether a number of 13 to 19 digits passes the Luhn check; spaces and dashes are left out."""
    plain = F.regexp_replace(digits, "[ -]", "")
    return plain.rlike(r"^\d{13,19}$") & F.call_function("luhn_check", plain)


def aba(digits: Column) -> Column:
    """Whether nine digits pass the routing number check: weights 3, 7, 1, a sum that ten divides and that isn't 0."""
    digit = lambda i: F.substring(digits, i + 1, 1).cast("int")
    total = sum((digit(i) * w for i, w in enumerate((3, 7, 1) * 3)), start=F.lit(0))
    return digits.rlike(r"^\d{9}$") & (total % 10 == 0) & (total > 0)


def mask(value: Column) -> Column:
    """First and last character, the rest as X; all X up to two characters."""
    n = F.length(value)
    return F.when(n <= 2, F.repeat(F.lit("X"), n)).otherwise(F.concat(F.left(value, F.lit(1)), F.repeat(F.lit("X"), n - 2), F.right(value, F.lit(1))))


def taxpayer_labels(text: Column) -> Column:
    """Labels of the patterns found, in their order."""
    return F.array_compact(F.array(*[F.when(text.rlike(ascii_bounds(p)), F.lit(label)) for label, p in TAXPAYER_PATTERNS]))


def identifying(labels: Column) -> Column:
    """Those labels that stop a document under any policy."""
    return F.array_intersect(labels, F.array(*map(F.lit, IDENTIFYING)))


def density_sweep(original: Column, redacted: Column, least: int = 3) -> Column:
    """Mask every bare nine-digit run if the original holds ``least`` of them and identifier words."""
    bare = ascii_bounds(BARE)
    dense = original.rlike(ascii_bounds(VOCABULARY)) & (F.regexp_count(original, F.lit(bare)) >= least)
    return F.when(dense, F.regexp_replace(redacted, bare, "[REDACTED-SSN]")).otherwise(redacted)


def screen_counts(text: Column) -> dict[str, Column]:
    """Hits per pattern of the corpus screen."""
    return {name: F.regexp_count(text, F.lit(ascii_bounds(p))) for name, p in SCREEN_PATTERNS}
