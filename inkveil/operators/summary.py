"""A run's verdicts as text. Only sums, and the first few of what is wrong, come to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from inkveil.operators import evaluate as E

FIRST_LEAKS, FIRST_FILES = 50, 10


def eval_report(truth: DataFrame, truth_files: DataFrame, original: DataFrame, redacted: DataFrame, outputs: DataFrame) -> tuple[str, bool]:
    """The text of run_eval()'s verdicts, and whether all hold."""
    files = E.classified(truth_files, outputs)
    graded = files.filter("status = 'graded'").select("doc_id")
    of = lambda d: d.join(graded, "doc_id", "left_semi")
    t, o, r = of(truth), of(original), of(redacted)
    leaked, by_type, kept = E.leaks(t, r), E.rates(t, r), E.retention(t, o, r)
    gates = E.gates(leaked, by_type, kept, files).first()
    n = {x["status"]: x["count"] for x in files.groupBy("status").count().collect()}
    lines = [f"leaks: {'none' if gates.leak_ok else leaked.count()}"]
    if not gates.leak_ok:
        lines += [f"  {x.doc_id}: {x.type} {x.surface!r} in {x.found_in}" for x in leaked.orderBy("doc_id", "type", "surface").limit(FIRST_LEAKS).collect()]
    share = lambda x: "n/a" if x is None else f"{x:.1%}"
    lines.append("by type: recall, look-alikes kept, doubtful kept")
    lines += [f"  {x.type}: {share(x.recall)}, {x.decoy_kept}/{x.decoy_total} {share(x.decoy_survival)}, {x.flag_kept}/{x.flag_total} {share(x.flag_survival)}" for x in by_type.orderBy("type").collect()]
    whole = kept.agg(F.try_divide(F.sum("kept"), F.sum("total")).alias("x")).first().x
    lines.append(f"opened: {n.get('graded', 0)} of {n.get('graded', 0) + n.get('broken', 0)}; words kept: {share(whole)}; refused: {n.get('refused', 0)}")
    for status in ("missing", "broken", "unexpected"):
        if n.get(status):
            some = [str(x.doc_id) for x in files.filter(F.col("status") == status).orderBy("doc_id").limit(FIRST_FILES).collect()]
            lines.append(f"{status}: {n[status]}: {', '.join(some)}")
    lines += [f"{g}: {'PASS' if gates[g] else 'FAIL'}" for g in E.GATES]
    passed = all(gates[g] for g in E.GATES)
    return "\n".join([*lines, f"VERDICT: {'PASS' if passed else 'FAIL'}"]) + "\n", passed
