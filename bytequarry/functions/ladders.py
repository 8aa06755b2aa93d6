"""Classification ladders: labels by cut points of the entropy (bits a byte)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Upper bounds (exclusive) and labels, the last label for all above; those of payloads are short forms.
REGION = (((1.0, "Constant/empty"), (4.0, "Plaintext/structured"), (6.0, "Structured data"), (7.5, "Dictionary-compressed"), (7.95, "Strong compression")), "Encrypted/random")
FINGERPRINT = (((4.0, "Plaintext"), (6.0, "Structured"), (7.5, "Dictionary-Compressed"), (7.95, "Strong-Compression")), "Encrypted/Random")
FINGERPRINT_CONFIDENCE = (((4.0, 0.7), (6.0, 0.5), (7.5, 0.6), (7.95, 0.5)), 0.3)
PAYLOAD = (((1.0, "Constant"), (4.0, "Uncompressed"), (6.5, "Structured"), (7.5, "Compressed")), "Encrypted")
BLOCK = (((3.0, "LowEntropy"), (5.5, "Structured"), (7.5, "Compressed")), "Random")


def ladder(value: Column, steps) -> Column:
    cuts, last = steps
    out = None
    for cut, label in cuts:
        out = F.when(value < cut, F.lit(label)) if out is None else out.when(value < cut, F.lit(label))
    return out.otherwise(F.lit(last))


def ladder_sql(value: str, steps) -> str:
    cuts, last = steps
    quote = lambda x: f"'{x}'" if isinstance(x, str) else f"{x}::DOUBLE"
    return "CASE " + " ".join(f"WHEN {value} < {cut} THEN {quote(label)}" for cut, label in cuts) + f" ELSE {quote(last)} END"


def classify_region(entropy: Column) -> Column:
    return ladder(entropy, REGION)


def classify_sliding(entropy: Column) -> Column:
    return F.when(entropy < 3.0, "LowEntropy").when(entropy > 7.0, "HighEntropy").otherwise("MediumEntropy")


def classify_block(entropy: Column, zero: Column, signature: Column) -> Column:
    return F.when(zero, "Empty").when(signature, "HasSignature").otherwise(ladder(entropy, BLOCK))


def classify_payload(entropy: Column) -> Column:
    return ladder(entropy, PAYLOAD)


def compressibility(entropy: Column, p_value: Column, serial: Column) -> Column:
    random = (entropy > 7.9) & (p_value > 0.01) & (F.abs(serial) < 0.05)
    return F.when(random, "random").when(entropy > 7, "high").when(entropy > 5, "moderate").otherwise("low")
