"""Which returned model identities a recorded pin accepts."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from pigeonhole import constants as k
from pigeonhole.functions.text import quote_regex


def model_accepted(returned: Column, pin: Column, policy: Column) -> Column:
    """Equal to the pin, or for an approved alias the pin with a date suffix."""
    dated = F.regexp(returned, F.concat(F.lit("^"), quote_regex(pin), F.lit("-[0-9]{4}-[0-9]{2}-[0-9]{2}$")))
    return (returned == pin) | ((policy == "owner_approved_alias") & dated)


def pin_valid(pin: Column, policy: Column, role: Column) -> Column:
    """The pin is a versioned identity of its role or an alias approved for it."""
    found = F.lit(False)
    for name in (k.CONFIDENCE, k.READER, k.RECOVERY):
        alias = pin.isin(k.PIN_ALIASES[name]) if k.PIN_ALIASES[name] else F.lit(False)
        ok = ((policy == "versioned") & pin.rlike(k.PIN_PATTERN[name])) | ((policy == "owner_approved_alias") & alias)
        found = found | ((role == name) & ok)
    return F.coalesce(found, F.lit(False))


def code_by_role(codes: dict[str, str], role: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in codes.items() for x in pair])[role]


def check_model_policy(pin: Column, policy: Column, role: Column, returned: Column) -> Column:
    """Finding struct or null: unusable pin (blocker), unidentified model (document), drift (blocker)."""
    def found(code: Column, kind: str, detail: str) -> Column:
        return F.struct(code.alias("code"), F.lit(kind).alias("kind"), F.lit(detail).alias("detail"))
    return (F.when(~pin_valid(pin, policy, role), found(F.lit("E_MODEL_POLICY"), "blocker", "model pin is not permitted"))
            .when(F.coalesce(F.length(returned), F.lit(0)) == 0, found(code_by_role(k.SCHEMA_CODE, role), "document", "response names no model"))
            .when(~model_accepted(returned, pin, policy), found(code_by_role(k.DRIFT_CODE, role), "blocker", "returned model is outside the pin")))
