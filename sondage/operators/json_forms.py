"""JSON texts in one form: digests that the order of keys doesn't change, execution plans cut down to what can be read."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What is kept of a plan's node, by name.
NODE_FIELDS = ("actRows", "cost", "depth", "estRows", "id", "objectName", "operation", "options", "parentId")
PREDICATES = ("accessPredicates", "filterPredicates")
MOST = 200


def canonical(c: Column) -> Column:
    """JSON text with sorted keys at every level and no white space; null if it is no JSON or names a key twice."""
    return F.to_json(F.try_parse_json(c))


def params_digest(c: Column) -> Column:
    """Equal for equal trees, whatever the order of their keys; a text that is no JSON is taken as it is."""
    return F.concat(F.lit("PD-"), F.substring(F.sha2(F.coalesce(canonical(c), c).cast("binary"), 256), 1, 12))


def pruned_plan(c: Column) -> Column:
    """A plan's nodes with the fields that say something and are not null; predicates are texts of some length, cut after 200 characters.

    Null if the text is no list of objects.
    """
    kind = ",".join(f"`{k}` variant" for k in sorted(NODE_FIELDS + PREDICATES))

    def node(n: Column) -> Column:
        field = lambda k: F.when(~F.is_variant_null(n[k]), n[k])

        def predicate(k: str) -> Column:
            s = F.when(F.schema_of_variant(n[k]) == "STRING", F.try_variant_get(n[k], "$", "string"))
            return F.when(F.length(s) > MOST, F.concat(F.substring(s, 1, MOST), F.lit("…"))).when(s != "", s)

        return F.struct(*[(predicate(k) if k in PREDICATES else field(k)).alias(k) for k in sorted(NODE_FIELDS + PREDICATES)])

    nodes = F.from_json(c, f"array<struct<{kind}>>")
    whole = F.schema_of_variant(F.try_parse_json(c))
    return F.when(whole.startswith("ARRAY<OBJECT") | (whole == "ARRAY<VOID>"), F.to_json(F.transform(nodes, node)))
