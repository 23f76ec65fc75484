"""Protected columns: joinable pseudonyms, display masks and encryption with the caller's key."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

SECURE = "secure_"


def pseudonym(c: Column, salt: str) -> Column:
    """Salted SHA-256: equal values stay equal, so joins on them still work."""
    return F.sha2(F.concat(F.lit(salt), c.cast("string")), 256)


def masked(c: Column) -> Column:
    """Letters and digits replaced, length kept."""
    return F.mask(c.cast("string"))


def encrypted(c: Column, key: Column) -> Column:
    """AES-GCM in base64; the key comes from the caller and is never stored here."""
    return F.base64(F.aes_encrypt(c.cast("string"), key))


def decrypted(c: Column, key: Column) -> Column:
    return F.try_aes_decrypt(F.unbase64(c), key).cast("string")


def protect(df: DataFrame, salt: str, columns: Iterable[str] | None = None) -> DataFrame:
    """Replace protected columns (by default every ``secure_*`` one) with pseudonyms.

    A protected reference keeps its shape; only the value it refers to is replaced.
    """
    names = list(columns) if columns is not None else [c for c in df.columns if c.startswith(SECURE)]
    out = {}
    for name in names:
        kind = df.schema[name].dataType
        if hasattr(kind, "fieldNames"):
            head = kind.fieldNames()[0]
            out[name] = F.col(name).withField(head, pseudonym(F.col(name)[head], salt))
        else:
            out[name] = pseudonym(F.col(name), salt)
    return df.withColumns(out)
