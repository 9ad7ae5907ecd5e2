"""The graph of modules: symbols, imports resolved to files, and edges between symbols, as joins over facts.

``facts`` is the table of ``source.facts``. An import names a file by a path relative to its own; the
first file that exists among the path and its usual endings is meant. A path is looked up once,
however many files import it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.joined import by_key

# Endings that an import leaves out, in the order in which they are tried.
ENDINGS = ["", ".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.js"]
CONFIDENT = 0.5


def normal_path(path: Column) -> Column:
    """A path without ``.`` and ``..``; a ``..`` above the top is dropped."""
    parts = F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/")
    up = lambda a: F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), lambda a, x: F.when(x == "..", up(a)).when(x == ".", a).otherwise(F.concat(a, F.array(x)))), "/")


def imported(facts: DataFrame) -> DataFrame:
    """(path, specifier, name, alias, kind, line) of each imported name."""
    return facts.select("path", F.inline("imports"))


def symbols(facts: DataFrame) -> DataFrame:
    """(path, name, local, kind, line) of each exported symbol."""
    return facts.select("path", F.inline("exports"))


def resolved(facts: DataFrame) -> DataFrame:
    """(path, specifier, dependency): imports of files that exist; others, such as packages, are left out."""
    rows = imported(facts).where(F.col("specifier").startswith(".")).select("path", "specifier").distinct()
    directory = F.regexp_replace("path", r"[\\/][^\\/]+$", "")
    rows = rows.select("path", "specifier", normal_path(F.concat(directory, F.lit("/"), "specifier")).alias("target"))
    files = facts.select(F.col("path").alias("dependency"), normal_path(F.col("path")).alias("file")).groupBy("file").agg(F.min("dependency").alias("dependency"))
    options = F.array(*[F.struct(F.lit(n).alias("priority"), F.concat("target", F.lit(e)).alias("file")) for n, e in enumerate(ENDINGS)])
    found = rows.select("target").distinct().select("target", F.inline(options)).join(by_key(files), "file")
    found = found.groupBy("target").agg(F.min_by("dependency", "priority").alias("dependency"))
    return rows.join(by_key(found), "target").select("path", "specifier", "dependency")


def uses(facts: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """(path, dependency, name, alias, kind, line): names that a file takes from another file of the program."""
    of = resolved(facts) if of is None else of
    rows = imported(facts).where(F.col("name").isNotNull() & F.col("specifier").startswith("."))
    return rows.join(by_key(of), ["path", "specifier"]).select("path", "dependency", "name", "alias", "kind", "line")


def edges(of: DataFrame) -> DataFrame:
    """(src, dst): each file and the files it imports."""
    return of.select(F.col("path").alias("src"), F.col("dependency").alias("dst")).distinct()


def dead(facts: DataFrame, used: DataFrame) -> DataFrame:
    """Exported (path, name, line) that no file imports by name; default and passed-on exports do not count."""
    own = symbols(facts).where("kind <> 're-export' and name <> 'default'").select("path", "name", "line")
    return own.join(by_key(used.select(F.col("dependency").alias("path"), "name")), ["path", "name"], "left_anti")


def defined(facts: DataFrame, used: DataFrame) -> DataFrame:
    """(path, alias, name, dependency, local, kind, line): each used name with the symbol that its file exports."""
    own = symbols(facts).groupBy(F.col("path").alias("dependency"), "name").agg(F.min_by(F.struct("local", F.col("kind").alias("symbol"), F.col("line").alias("at")), "line").alias("s"))
    return used.select("path", "dependency", "name", "alias").distinct().join(by_key(own), ["dependency", "name"]).select("path", "alias", "name", "dependency", "s.*")


def cross_file_taint(facts: DataFrame, used: DataFrame) -> DataFrame:
    """(consumer, source, symbol, line, sink, sink_line, confidence): for each file and file it imports, the best of
    the imported file's own paths from input to a sink, and the import that lies nearest to it.

    A path in the function that a symbol names stands before others of that file, then confidence, then the first line.
    """
    from .source import CONFIDENCE

    paths = facts.select("path", F.inline("flows")).where("origin <> 'param' and target not like 'call:%'")
    paths = paths.groupBy(F.col("path").alias("dependency"), "function").agg(F.min(F.struct("target_line", "target")).alias("p"), F.lit(CONFIDENCE).alias("confidence")).where(F.col("confidence") >= CONFIDENT)
    rows = used.join(by_key(symbols(facts).select(F.col("path").alias("dependency"), "name", "local").distinct()), ["dependency", "name"], "left")
    whole = paths.groupBy("dependency").agg(F.min("p").alias("any"), F.max("confidence").alias("most"))
    own = paths.select("dependency", F.col("function").alias("local"), F.col("p").alias("own"))
    rows = rows.join(by_key(whole), "dependency").join(by_key(own), ["dependency", "local"], "left")
    best = F.struct(F.col("own").isNull().alias("far"), (-F.col("most")).alias("doubt"), "line", "name", F.coalesce("own", "any").alias("p"))
    rows = rows.groupBy(F.col("path").alias("consumer"), F.col("dependency").alias("source")).agg(F.min(best).alias("b"))
    return rows.select("consumer", "source", F.col("b.name").alias("symbol"), F.col("b.line").alias("line"), F.col("b.p.target").alias("sink"), F.col("b.p.target_line").alias("sink_line"), (-F.col("b.doubt")).alias("confidence"))
