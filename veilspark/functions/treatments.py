"""Treatments of personal data, as column expressions.

A treatment maps ``(value, entity)`` to a replacement. Keys stay out of logs only if plans that hold them
are not printed: a key is a literal of the plan.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Mapping
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: texts written in place of data ---------------------------------------------
BINARY_REMOVED = "<binary data removed>"
ACCESS_DENIED = "<access denied>"
TRUNCATED_REDACTED = "<content truncated and redacted>"
HASH_NEEDS_KEY = "[hash requires HMAC key]"
PSEUDONYMISE_NEEDS_KEY = "[pseudonymise requires key]"
REPLACED = "[REPLACED]"
TOKEN_PREFIX = "pii:"


def redacted_text(entity: Column) -> Column:
    return F.concat(F.lit("<redacted: "), entity, F.lit(">"))


def truncated_text(length: int) -> str:
    return f"<content truncated at {length}>"


# --- fixed values: kinds of treatment ---------------------------------------------------------
NONE = "none"
REDACTED = "redacted"
HASHED = "hashed"
PSEUDONYMISED = "pseudonymised"
MASKED = "masked"
TRUNCATED = "truncated"
TRUNCATED_AND_REDACTED = "truncated_and_redacted"
STRIPPED = "stripped"


@dataclass(frozen=True)
class Treatment:
    """A named treatment; ``kind`` is what a report says was done."""

    name: str
    kind: str
    apply: Callable[[Column, Column], Column]


def redact() -> Treatment:
    return Treatment("redact", REDACTED, lambda value, entity: redacted_text(entity))


def hmac_sha256(value: Column, key: bytes) -> Column:
    """Keyed digest in hex. The two padded keys are made once on the driver."""
    block = key if len(key) <= 64 else hashlib.sha256(key).digest()
    block = block.ljust(64, b"\0")
    inner = F.lit(bytes(b ^ 0x36 for b in block))
    outer = F.lit(bytes(b ^ 0x5C for b in block))
    digest = F.unhex(F.sha2(F.concat(inner, value.cast("binary")), 256))
    return F.sha2(F.concat(outer, digest), 256)


def hash_with(key: bytes | None) -> Treatment:
    if not key:
        return Treatment("hash", HASHED, lambda value, entity: F.lit(HASH_NEEDS_KEY))
    return Treatment("hash", HASHED, lambda value, entity: hmac_sha256(value, key))


def mask(keep_last: int = 4) -> Treatment:
    keep = keep_last if keep_last > 0 else 4

    def apply(value: Column, entity: Column) -> Column:
        size = F.length(value)
        hidden = F.when(size <= keep, size).otherwise(size - keep)
        return F.concat(F.repeat(F.lit("*"), hidden), F.substr(value, hidden + F.lit(1)))

    return Treatment("mask", MASKED, apply)


def _split_key(key: bytes) -> tuple[bytes, bytes]:
    if len(key) not in (32, 64):
        raise ValueError("a pseudonym key has 32 or 64 bytes: one half encrypts, one half makes the IV")
    half = len(key) // 2
    return key[:half], key[half:]


def pseudonymise(key: bytes | None) -> Treatment:
    """Reversible tokens: equal values give equal tokens, so tokens can be joined and filtered on.

    The 12-byte IV is a keyed digest of the value itself. Two values share an IV with a chance that
    matters only beyond about 2**48 distinct values under one key; change keys before that.
    """
    if not key:
        return Treatment("pseudonymise", PSEUDONYMISED, lambda v, e: F.lit(PSEUDONYMISE_NEEDS_KEY))
    cipher_key, iv_key = _split_key(key)

    def apply(value: Column, entity: Column) -> Column:
        raw = value.cast("binary")
        iv = F.substring(F.unhex(hmac_sha256(value, iv_key)), 1, 12)
        sealed = F.aes_encrypt(raw, F.lit(cipher_key), F.lit("GCM"), F.lit("DEFAULT"), iv)
        token = F.concat(F.lit(TOKEN_PREFIX), F.lower(F.hex(sealed)))
        return F.when(F.length(value) == 0, value).otherwise(token)

    return Treatment("pseudonymise", PSEUDONYMISED, apply)


def detokenise(token: Column, key: bytes | None) -> Column:
    """``struct<value, error>``; exactly one of the two is set for a token that is not null."""
    body = F.substr(token, F.lit(len(TOKEN_PREFIX) + 1))
    is_token = token.startswith(TOKEN_PREFIX)
    is_hex = body.rlike(r"\A(?:[0-9a-fA-F]{2})+\z")
    if not key:
        error, value = F.lit("no key"), F.lit(None).cast("string")
    else:
        cipher_key, _ = _split_key(key)
        plain = F.try_aes_decrypt(F.unhex(body), F.lit(cipher_key), F.lit("GCM"), F.lit("DEFAULT"))
        value = F.when(is_token & is_hex, plain.cast("string"))
        error = (
            F.when(~is_token, "not a token")
            .when(~is_hex, "invalid token encoding")
            .when(value.isNull(), "wrong key or changed token")
        )
    return F.struct(value.alias("value"), F.when(token.isNotNull(), error).alias("error"))


def replace(text: str = REPLACED) -> Treatment:
    return Treatment("replace", REDACTED, lambda value, entity: F.lit(text or REPLACED))


def custom(function: Callable[[Column, Column], Column] | None = None) -> Treatment:
    """A user's function of (value, entity) columns; without one, values stay as they are.

    For whole columns the function may call a Pandas UDF. Inside free text it must use built-in
    functions, as it runs within a lambda.
    """
    return Treatment("custom", REDACTED, function or (lambda value, entity: value))


def custom_batches(function: Callable[[pd.Series, pd.Series], pd.Series]) -> Treatment:
    """A user's function of pandas Series (values, entities), called once per Arrow batch.

    The function sees values that are not null, and must give as many, in their order; nulls stay null. For whole columns
    only, as free text is treated within a lambda.
    """

    def treat(values: pd.Series, entities: pd.Series) -> pd.Series:
        filled = values.notna().to_numpy()
        done = pd.Series([None] * len(values), dtype=object)
        if filled.any():
            given = function(values[filled].reset_index(drop=True), entities[filled].reset_index(drop=True))
            if len(given) != filled.sum():
                raise ValueError(f"the treatment gave {len(given)} values for {filled.sum()}")
            done[filled] = list(given)
        return done

    batches = F.pandas_udf(treat, "string")
    return Treatment("custom", REDACTED, lambda value, entity: batches(value, entity))


class TreatmentMap:
    """A default treatment and overrides by entity; entity names are matched without case."""

    def __init__(self, default: Treatment | None = None, overrides: Mapping[str, Treatment] | None = None):
        self.default = default or redact()
        self.overrides = {name.upper(): t for name, t in (overrides or {}).items()}

    @classmethod
    def from_config(
        cls, default: str = "redact", overrides: Mapping[str, str] | None = None, key: bytes | None = None
    ) -> TreatmentMap:
        """From treatment names, as they stand in a settings file."""
        makers = {
            "redact": redact,
            "hash": lambda: hash_with(key),
            "mask": mask,
            "pseudonymise": lambda: pseudonymise(key),
            "replace": replace,
            "custom": custom,
        }
        unknown = ({default} | set((overrides or {}).values())) - set(makers)
        if unknown:
            raise ValueError(f"unknown treatments: {sorted(unknown)}")
        return cls(makers[default](), {e: makers[n]() for e, n in (overrides or {}).items()})

    def of(self, entity: str) -> Treatment:
        return self.overrides.get(entity.upper(), self.default)

    def _choose(self, entity: Column, pick: Callable[[Treatment], Column]) -> Column:
        chosen = None
        for name, treatment in self.overrides.items():
            case = F.when if chosen is None else chosen.when
            chosen = case(entity == name, pick(treatment))
        return pick(self.default) if chosen is None else chosen.otherwise(pick(self.default))

    def apply(self, value: Column, entity: Column) -> Column:
        return self._choose(entity, lambda t: t.apply(value, entity))

    def kind(self, entity: Column) -> Column:
        return self._choose(entity, lambda t: F.lit(t.kind))
