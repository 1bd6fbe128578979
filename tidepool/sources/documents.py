"""Nested documents as rows: a table function over JSON, and who funded a wallet in a transaction."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, BooleanType, StringType, StructField, StructType

MAX_DEPTH, MAX_HITS = 16, 600  # fixed values: how deep a search for a field goes, and how many it finds in a document


def _parsed(doc: str | None):
    try:
        return True, json.loads(doc)
    except (TypeError, ValueError):
        return False, None


_KINDS = {str: "string", bool: "boolean", int: "number", float: "number", type(None): "null", dict: "object", list: "array"}


@F.udtf(returnType="path string, kind string, value string")
class Leaves:
    """The leaves of a JSON document (and its empty objects and arrays) in order: path as a JSON pointer, kind, value as text. A text that isn't JSON has none."""

    def eval(self, doc: str) -> Iterator[tuple[str, str, str | None]]:
        known, root = _parsed(doc)
        left = [("", root)] if known else []
        while left:
            path, node = left.pop()
            inner = node.items() if isinstance(node, dict) else enumerate(node) if isinstance(node, list) else ()
            inner = [(f"{path}/{str(k).replace('~', '~0').replace('/', '~1')}", v) for k, v in inner]
            if inner:
                left += reversed(inner)
            else:
                text = node if isinstance(node, str) else None if node is None or isinstance(node, (dict, list)) else json.dumps(node)
                yield path, _KINDS[type(node)], text


@F.udtf(returnType="path string, value string")
class Found:
    """The values of a field at any depth, objects before what is in them; at most MAX_HITS, no deeper than MAX_DEPTH names."""

    def eval(self, doc: str, field: str) -> Iterator[tuple[str, str]]:
        _, root = _parsed(doc)
        left, hits = [((), root)], 0
        while left and hits < MAX_HITS:
            path, node = left.pop()
            if path and isinstance(path[-1], str) and path[-1] == field:
                hits += 1
                yield ".".join(map(str, path)), json.dumps(node)
            if len(path) <= MAX_DEPTH:
                inner = list(node.items()) if isinstance(node, dict) else list(enumerate(node)) if isinstance(node, list) else []
                left += [((*path, k), v) for k, v in reversed(inner)]


def leaves(df: DataFrame, doc: str) -> DataFrame:
    """The rows with path, kind and value of each leaf of their documents; rows without leaves go."""
    return df.lateralJoin(Leaves(F.col(doc).outer()))


def json_walk(df: DataFrame, id_: str, doc: str, field: str) -> DataFrame:
    """(id, path, value): every value of ``field`` in a JSON document, with its path."""
    return df.select(id_, doc).lateralJoin(Found(F.col(doc).outer(), F.lit(field))).select(id_, "path", "value")


# Programs that are party to transfers and fund nobody.
NON_FUNDERS = ("11111111111111111111111111111111", "1nc1nerator11111111111111111111111111111111", "SysvarRent111111111111111111111111111111111", "ComputeBudget111111111111111111111111111111")
_FIELDS = ("destination", "newAccount", "source", "lamportsSource", "wallet", "owner")
_MOVES = StructType([StructField("read", BooleanType()), StructField("parties", ArrayType(StructType([StructField(f, StringType()) for f in _FIELDS])))] + [StructField(n, ArrayType(StringType())) for n in ("accountKeys", "preBalances", "postBalances")])


def _inside(node, *names):
    for name in names:
        node = node.get(name) if isinstance(node, dict) else None
    return node


def _listed(node, *names) -> list:
    found = _inside(node, *names)
    return found if isinstance(found, list) else []


def _moves(doc: str | None) -> dict:
    """Who was party to a transaction's instructions, top-level ones before inner ones, and its accounts with their balances."""
    read, tx = _parsed(doc)
    message = _inside(tx, "transaction", "message")
    steps = _listed(message, "instructions") + [x for inner in _listed(tx, "meta", "innerInstructions") for x in _listed(inner, "instructions")]
    infos = [info for x in steps if isinstance(info := _inside(x, "parsed", "info"), dict)]
    parties = [{f: v for f in _FIELDS if isinstance(v := info.get(f), str) and v} for info in infos]
    keys = [_inside(k, "pubkey") if isinstance(k, dict) else k for k in _listed(message, "accountKeys")]
    amount = lambda v: v if isinstance(v, str) else None if v is None or isinstance(v, (dict, list)) else json.dumps(v)
    balances = {name: [amount(v) for v in _listed(tx, "meta", name)] for name in ("preBalances", "postBalances")}
    return {"read": read, "parties": parties, "accountKeys": [k for k in keys if isinstance(k, str)]} | balances


@F.arrow_udf(_MOVES)
def moves(docs: pa.Array) -> pa.Array:
    return pa.array([_moves(doc) for doc in docs.to_pylist()], to_arrow_type(_MOVES))


def funders(transactions: DataFrame) -> DataFrame:
    """(tx_id, wallet, funder, mechanism) for transactions (tx_id, wallet, doc: JSON).

    In this order: the source of the first parsed transfer to the wallet, top-level instructions before
    inner ones; who paid for an account that the wallet owns; who lost most where the wallet gained.
    Mechanisms are transfer, account-payer, balance-delta, none, and no-transaction where doc isn't JSON.
    """
    rows = transactions.select("tx_id", "wallet", moves("doc").alias("m")).select("tx_id", "wallet", "m.*")
    # A transaction is one row throughout: what it takes is in its own document.
    other = lambda who: (who != F.col("wallet")) & ~who.isin(*NON_FUNDERS)

    def first(source, target):
        who = F.transform("parties", lambda p: F.when((target(p) == F.col("wallet")) & other(source(p)), source(p)))
        return F.get(F.filter(who, lambda x: x.isNotNull()), F.lit(0))

    by_transfer = first(lambda p: F.coalesce(p["source"], p["lamportsSource"]), lambda p: F.coalesce(p["destination"], p["newAccount"]))
    by_payer = first(lambda p: p["source"], lambda p: F.coalesce(p["wallet"], p["owner"]))
    amount = lambda which, i: F.get(which, i).try_cast("decimal(38,0)")
    whole = (F.size("accountKeys") == F.size("preBalances")) & (F.size("accountKeys") == F.size("postBalances"))
    lines = F.transform("accountKeys", lambda k, i: F.struct((amount("preBalances", i) - amount("postBalances", i)).alias("lost"), (-i).alias("back"), k.alias("key")))
    own = F.get(F.filter("lines", lambda x: x["key"] == F.col("wallet")), F.lit(0))
    most = F.array_max(F.filter("lines", lambda x: other(x["key"]) & (x["lost"] > 0)))["key"]
    rows = rows.select("tx_id", "wallet", "read", by_transfer.alias("by_transfer"), by_payer.alias("by_payer"), F.when(whole, lines).alias("lines"))
    rows = rows.withColumn("by_delta", F.when(own["lost"] < 0, most))
    how = F.when(F.col("by_transfer").isNotNull(), "transfer").when(F.col("by_payer").isNotNull(), "account-payer").when(F.col("by_delta").isNotNull(), "balance-delta").when(F.col("read"), "none").otherwise("no-transaction")
    return rows.select("tx_id", "wallet", F.coalesce("by_transfer", "by_payer", "by_delta").alias("funder"), how.alias("mechanism"))
