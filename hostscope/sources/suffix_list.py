"""Public Suffix List -> small rule table (U4 input).

The list is a fixed reference file of a few thousand lines; it is parsed once
on the driver into ``rules(key, is_exact, is_wild_parent, is_exception)``.
By default the ICANN section of the snapshot in ``hostscope/data`` is used (the
list is published under the MPL 2.0; the notice is in the file's head); pass
``path`` to use another snapshot (the file may be on any Hadoop-readable path:
it is read with ``spark.read.text``).

Each multi-label rule is also keyed in every mix of Unicode / punycode label
forms, so hosts written either way find their suffix without decoding.
"""

from __future__ import annotations

import itertools
import os
from functools import lru_cache
from importlib import resources

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# Hard size bound for the broadcast side (the real list has ~7.4k rules; all
# label-form variants stay under 10k).  Anything bigger is not a suffix list.
MAX_RULES = 100_000
MAX_LIST_LINES = 1_000_000

RULE_SCHEMA = T.StructType(
    [
        T.StructField("key", T.StringType(), False),
        T.StructField("is_exact", T.BooleanType(), False),
        T.StructField("is_wild_parent", T.BooleanType(), False),
        T.StructField("is_exception", T.BooleanType(), False),
    ]
)


def _bundled_text() -> str:
    return resources.files("hostscope").joinpath("data", "public_suffix_list.dat").read_text("utf-8")


def icann_rules(text: str, include_private: bool = False) -> list[str]:
    """Rule lines of the ICANN section (and the private one if asked)."""
    out, section = [], None
    for line in text.splitlines():
        s = line.strip()
        if "===BEGIN ICANN DOMAINS===" in s:
            section = "icann"
        elif "===BEGIN PRIVATE DOMAINS===" in s:
            section = "private"
        elif "===END" in s:
            section = None
        elif s and not s.startswith("//") and section is not None:
            if section == "icann" or include_private:
                out.append(s.split()[0].lower())
    return out


def _label_forms(label: str) -> set[str]:
    forms = {label}
    if not label.isascii():
        try:
            import idna

            forms.add(idna.encode(label).decode("ascii"))
        except Exception:
            try:
                forms.add(label.encode("idna").decode("ascii"))
            except Exception:
                forms.add("xn--" + label.encode("punycode").decode("ascii"))
    return forms


def _key_forms(key: str) -> list[str]:
    labels = key.split(".")
    return [".".join(p) for p in itertools.product(*[sorted(_label_forms(x)) for x in labels])]


def rule_rows(rules: list[str]) -> list[tuple[str, bool, bool, bool]]:
    flags: dict[str, list[bool]] = {}
    for r in rules:
        if r.startswith("!"):
            key, idx = r[1:], 2
        elif r.startswith("*."):
            key, idx = r[2:], 1
        else:
            key, idx = r, 0
        for k in _key_forms(key):
            flags.setdefault(k, [False, False, False])[idx] = True
    return [(k, v[0], v[1], v[2]) for k, v in sorted(flags.items())]


@lru_cache(maxsize=4)
def _rows_for(path: str | None, include_private: bool) -> tuple:
    text = _bundled_text() if path is None else None
    if text is None:
        with open(path, encoding="utf-8") as fh:
            text = fh.read()
    return tuple(rule_rows(icann_rules(text, include_private)))


def max_rule_labels(rows) -> int:
    """Longest suffix a rule can produce (wildcards add one label)."""
    best = 1
    for key, exact, wild, exc in rows:
        n = key.count(".") + 1
        best = max(best, n + (1 if wild else 0), n)
    return best


def suffix_rules(
    spark: SparkSession, path: str | None = None, include_private: bool = False
) -> DataFrame:
    """The rule table as a DataFrame (size-checked; safe to broadcast)."""
    if path is not None and not os.path.exists(path):
        text = spark.read.text(path)  # one file on shared storage, read in order
        if text.limit(MAX_LIST_LINES + 1).count() > MAX_LIST_LINES:
            raise ValueError(f"{path} has more than {MAX_LIST_LINES} lines; not a suffix list")
        lines = [r.value for r in text.collect()]
        rows = rule_rows(icann_rules("\n".join(lines), include_private))
    else:
        rows = list(_rows_for(path, include_private))
    if len(rows) > MAX_RULES:
        raise ValueError(f"suffix list has {len(rows)} keys, above the {MAX_RULES} bound")
    return spark.createDataFrame(rows, RULE_SCHEMA)


def suffix_rule_rows(path: str | None = None, include_private: bool = False) -> list:
    return list(_rows_for(path, include_private))
