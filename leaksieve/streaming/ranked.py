"""The ranking of a unit's ambiguous findings over a stream, where a unit may come in any number of batches.

Only the best three of a unit are held, whatever it has: a finding that three better ones displace won't be asked
about any more and leaves at once, as do those that are sure. The three leave when the unit ends: at its end mark,
or when nothing came of it for some time. What waits is the state of the stream, so a restart loses none; it
holds fingerprints in place of secrets. Run it with a trigger that goes on: one that stops when nothing is left
(``availableNow``) waits for every timer first.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import detect, route
from ..operators.baseline import fingerprint
from ..operators.rules import RULES, Rule

#: What a row says of a finding, and what ends a unit beside it.
FIELDS = ("file", "ext", "line_no", "layer", "rule_id", "description", "snippet", "redacted", "confidence", "tier", "ai_skipped", "phase", "view", "rule_no", "occurrence", "fingerprint")
ROW = "unit_id string, file string, ext string, line_no int, layer string, rule_id string, description string, snippet string, redacted string, confidence double, tier string, ai_skipped boolean, phase int, view int, rule_no int, occurrence int, fingerprint string, asked boolean, rank int"


def _order(r: dict) -> tuple:
    """As ``route.ORDER`` says: confidence first, then where the detectors come to it; a null file before any name."""
    return (-r["confidence"], r["phase"], r["file"] is not None, r["file"] or "", r["line_no"], r["view"], r["rule_no"], r["occurrence"])


def _plain(value):
    return None if value is None or value != value else value.item() if hasattr(value, "item") else value  # noqa: PLR0124


def ranked(findings: DataFrame, ends: DataFrame, silence: str = "10 minutes") -> DataFrame:
    """``findings`` (detect.FINDING) as a stream, each once, with asked and rank (from 1; null where it isn't asked about).

    ``ends`` (unit_id) are the units' end marks, of the same stream or another. A unit that goes on after its end begins anew.
    """
    waits = int(pd.Timedelta(silence).total_seconds() * 1000)
    prints = fingerprint(F.col("file"), F.col("rule_id"), F.col("secret"), F.col("snippet"))
    rows = findings.where(route.band(F.col("confidence")) != "dropped")
    rows = rows.withColumns({"fingerprint": prints, "view": F.col("match_ord.view"), "rule_no": F.col("match_ord.rule_no"), "occurrence": F.col("match_ord.occurrence")}).select("unit_id", *FIELDS, F.lit(False).alias("ended"))
    marks = ends.select("unit_id", *(F.lit(None).cast(dict(rows.dtypes)[c]).alias(c) for c in FIELDS), F.lit(True).alias("ended"))

    def hold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = json.loads(state.get[0]) if state.exists else []
        ended, leaving = state.hasTimedOut, []
        for pdf in batches:
            ended = ended or bool(pdf["ended"].any())
            for r in ({k: _plain(v) for k, v in x.items()} for x in pdf.loc[~pdf["ended"].astype(bool), list(FIELDS)].to_dict("records")):
                if r["confidence"] >= route.HIGH:
                    leaving.append(r | {"asked": False, "rank": None})
                    continue
                held = sorted([*held, r], key=_order)
                leaving += [x | {"asked": False, "rank": None} for x in held[route.ADJUDICATED :]]
                held = held[: route.ADJUDICATED]
        if ended:
            leaving += [r | {"asked": True, "rank": n} for n, r in enumerate(held, 1)]
            if state.exists:
                state.remove()
        else:
            state.update((json.dumps(held),))
            state.setTimeoutDuration(waits)
        out = pd.DataFrame(leaving, columns=[*FIELDS, "asked", "rank"])
        out.insert(0, "unit_id", key[0])
        yield out.astype({c: "Int32" for c in ("line_no", "phase", "view", "rule_no", "occurrence", "rank")} | {"confidence": "float64", "asked": "bool", "ai_skipped": "boolean"})

    both = rows.unionByName(marks)
    return both.groupBy("unit_id").applyInPandasWithState(hold, ROW, "held string", "append", GroupStateTimeout.ProcessingTimeTimeout)


def ranked_lines(lines: DataFrame, ended: Column, rules: Sequence[Rule] = RULES, silence: str = "10 minutes", **entropy) -> DataFrame:
    """A stream of numbered lines (unit_id, file, ext, line_no, text) to ranked findings of rules and entropy; ``ended`` tells a unit's last row, whose text may be null."""
    plain = lines.select("unit_id", "file", "ext", "line_no", "text")
    return ranked(detect.line_findings(plain.where("text is not null"), rules, True, entropy), lines.where(ended).select("unit_id"), silence)
