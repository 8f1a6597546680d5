"""What kind of work a session was, from its prompts' words and the tools it used."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words by task type, in the order of the types' ranks. Fixed values.
KEYWORDS: dict[str, tuple[str, ...]] = {
    "Debugging": ("fix", "bug", "error", "broken", "crash", "fails", "debug", "stack trace", "exception", "regression"),
    "FeatureWork": ("add", "implement", "create", "build", "feature", "support", "new", "endpoint"),
    "Refactoring": ("refactor", "rename", "clean up", "extract", "simplify", "reorganize", "move", "dedupe"),
    "Testing": ("test", "tests", "coverage", "assert", "unit test", "integration test"),
    "Documentation": ("document", "docs", "readme", "comment", "changelog", "explain in writing"),
    "Exploration": ("review", "explain", "understand", "how does", "what does", "look at", "analyze", "investigate", "find", "trace"),
    "ConfigOps": (
        "ci", "cd", "deploy", "pipeline", "config", "dependency", "dependencies", "upgrade", "bump", "cargo", "npm", "docker", "workflow", "version",
    ),
}
TYPES = (*KEYWORDS, "Unknown")
#: Tools that count, in the order of the note; several names may count as one tool. Fixed values.
TOOLS: dict[str, tuple[str, ...]] = {
    "Edit": ("Edit", "MultiEdit"), "Write": ("Write",), "Bash": ("Bash",), "Read": ("Read",), "Grep": ("Grep",), "Glob": ("Glob",),
}


def tool_counts(name: str = "name") -> list[Column]:
    return [F.count_if(F.col(name).isin(*names)).alias(f"n_{tool.lower()}") for tool, names in TOOLS.items()]


def _bonus(task: str) -> Column:
    edit, write, bash = F.col("n_edit"), F.col("n_write"), F.col("n_bash")
    browse = F.col("n_read") + F.col("n_grep") + F.col("n_glob")
    by_task = {
        "Debugging": F.when((bash >= 3) & (edit >= 1), 3.0).when((bash >= 1) & (edit >= 1), 1.0),
        "FeatureWork": F.when((write >= 1) & (edit >= 1), 3.0).when(write >= 1, 1.5),
        "Refactoring": F.when((edit >= 3) & (write == 0), 3.0),
        "Exploration": F.when((browse > 0) & (edit == 0) & (write == 0), 3.0),
    }
    return by_task[task].otherwise(0.0) if task in by_task else F.lit(0.0)


def classify(sessions: DataFrame, prompts: str = "prompts") -> DataFrame:
    """``sessions`` (with an array of lower-case prompts and the tool counts) with task_type,
    confidence and signals.

    Two points for each distinct word that is part of any prompt, plus the tools' bonus; the best
    type wins, ties by rank; no points at all is Unknown.
    """
    hit = lambda w: F.exists(prompts, lambda p: F.contains(p, F.lit(w)))
    scored = []
    for rank, (task, words) in enumerate(KEYWORDS.items()):
        found = F.filter(F.array(*[F.when(hit(w), F.lit(w)) for w in words]), lambda x: x.isNotNull())
        scored.append(F.struct(
            F.lit(task).alias("task"), F.lit(-rank).alias("rank"), found.alias("words"), _bonus(task).alias("bonus"),
        ))
    out = sessions.withColumn("_types", F.array(*scored))
    out = out.withColumn("_types", F.transform("_types", lambda t: F.struct(
        (F.size(t["words"]) * 2.0 + t["bonus"]).alias("score"), t["rank"].alias("rank"), t["task"].alias("task"), t["words"].alias("words"), t["bonus"].alias("bonus"))))
    out = out.withColumn("_best", F.array_max("_types")).withColumn("_sum", F.aggregate("_types", F.lit(0.0), lambda a, t: a + t["score"]))
    some = F.col("_best.score") > 0
    mix = F.concat_ws(", ", *[F.when(F.col(f"n_{t.lower()}") > 0, F.concat_ws(" ", F.col(f"n_{t.lower()}"), F.lit(t))) for t in TOOLS])
    note = F.when((F.col("_best.bonus") > 0) & (mix != ""), F.array(F.concat(F.lit("tool mix: "), mix))).otherwise(F.array().cast("array<string>"))
    words = F.transform("_best.words", lambda w: F.concat(F.lit('prompt keyword: "'), w, F.lit('"')))
    return (
        out.withColumn("task_type", F.when(some, F.col("_best.task")).otherwise("Unknown"))
        .withColumn("confidence", F.when(some, F.least(F.greatest(F.col("_best.score") / F.col("_sum"), F.lit(0.0)), F.lit(1.0))).otherwise(0.0))
        .withColumn("signals", F.when(some, F.concat(words, note)).otherwise(F.array().cast("array<string>")))
        .drop("_types", "_best", "_sum")
    )


def rank_of(task: Column) -> Column:
    return F.array_position(F.array(*[F.lit(t) for t in TYPES]), task)
