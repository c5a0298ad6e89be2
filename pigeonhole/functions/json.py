"""JSON text columns: parsed once to a variant, then read by token so that types stay visible."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once and use it many times in ``body``.

    A plain intermediate column is substituted into every use when a filter moves below its projection; a bound
    value stays one evaluation however the plan is rewritten.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


END = "\ue000end"  # closes the list a text is parsed in


def parse(c: Column) -> Column:
    """Variant value, null for malformed text.

    The parser alone ignores what follows the first value. So a text is parsed as the first of two elements, the second being
    a mark that the text doesn't hold: the mark stands second only where the text is one whole value. A text that does hold
    it is tested inside brackets and inside braces instead, as no trailing text can close both.
    """
    element = lambda a, i: F.try_variant_get(a, f"$[{i}]", "variant")

    def marked(t: Column) -> Column:
        return let(F.try_parse_json(F.concat(F.lit("["), t, F.lit(f',"{END}"]'))),
                   lambda a: F.when((F.try_variant_get(a, "$[1]", "string") == END) & element(a, 2).isNull(), element(a, 0)))

    def twice(t: Column) -> Column:
        inside = F.try_parse_json(F.concat(F.lit('{"v":'), t, F.lit("}"))).isNotNull()
        return let(F.try_parse_json(F.concat(F.lit("["), t, F.lit("]"))), lambda a: F.when(element(a, 1).isNull() & inside, element(a, 0)))

    return let(c, lambda t: F.when(F.contains(t, F.lit(END)), twice(t)).otherwise(marked(t)))


def json_token(v: Column, path: str) -> Column:
    """The value at ``path`` as JSON text: quoted for strings, ``null`` for JSON null, SQL null when absent."""
    return F.to_json(F.try_variant_get(v, path, "variant"))


def kind(v: Column, path: str = "$") -> Column:
    """``STRING``, ``BOOLEAN``, ``BIGINT``, ``ARRAY<...>``, ``VOID`` (JSON null) or SQL null when absent. Meant for scalars."""
    return F.schema_of_variant(F.try_variant_get(v, path, "variant"))


def present(v: Column, path: str) -> Column:
    """The path exists (JSON null counts)."""
    return F.try_variant_get(v, path, "variant").isNotNull()


def is_object(v: Column, path: str = "$") -> Column:
    """A shallow cast, because naming the full schema of a large value costs far more than its outer type."""
    return F.try_variant_get(v, path, "map<string,variant>").isNotNull()


def is_array(v: Column, path: str = "$") -> Column:
    return F.try_variant_get(v, path, "array<variant>").isNotNull()


def is_string(v: Column, path: str = "$") -> Column:
    return F.coalesce(kind(v, path) == "STRING", F.lit(False))


def is_null(v: Column, path: str = "$") -> Column:
    """Absent or JSON null."""
    k = kind(v, path)
    return k.isNull() | (k == "VOID")


def keys(v: Column, path: str = "$") -> Column:
    """Distinct keys of the object at ``path`` (null for anything else)."""
    return F.map_keys(F.try_variant_get(v, path, "map<string,variant>"))


def exact_keys(v: Column, names: Column, path: str = "$") -> Column:
    return F.coalesce(let(keys(v, path), lambda found: (F.size(found) == F.size(names)) & (F.size(F.array_except(found, names)) == 0)), F.lit(False))
