"""Many nets as tables, and as PNML documents that Spark writes and reads: expressions make the text and take it apart.

places       net_id, pid, name, initial, final (tokens)
transitions  net_id, tid, name, silent, weight, guard (a text, "true" where there is none)
arcs         net_id, source, target (ids of nodes)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodetrace.functions.scratch import written
from lodetrace.sources.pnml import PROM_TOOL, WEIGHT_TOOL

NET_TYPE = "http://www.pnml.org/version-2009/grammar/pnmlcoremodel"

_TEXT = "struct<text: string>"
_TOOLS = "array<struct<_tool: string, _weight: string, _activity: string, property: array<struct<_key: string, _VALUE: string>>>>"
_LIST = "struct<marking: array<struct<place: array<struct<_idref: string, text: string>>>>>"
_BODY = (f"place: array<struct<_id: string, name: {_TEXT}, initialMarking: {_TEXT}, finalMarking: {_TEXT}>>, "
         f"transition: array<struct<_id: string, _invisible: string, _guard: string, name: {_TEXT}, toolspecific: {_TOOLS}>>, "
         f"arc: array<struct<_source: string, _target: string>>, initialmarkings: {_LIST}, finalmarkings: {_LIST}")
#: What of a document is read.
DOCUMENT = f"net array<struct<_id: string, name: {_TEXT}, page: array<struct<{_BODY}>>, {_BODY}>>"


def escaped(c: Column) -> Column:
    """Text for elements and attributes; characters that XML can't hold become U+FFFD."""
    c = F.regexp_replace(c, "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\uFFFE\\uFFFF]", "�")
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("\t", "&#9;"), ("\n", "&#10;"), ("\r", "&#13;")):
        c = F.replace(c, F.lit(char), F.lit(name))
    return c


def _tag(name: str, attributes: dict[str, Column], inner: Column | None = None) -> Column:
    parts = [F.lit(f"<{name}")]
    for key, value in attributes.items():
        parts.append(F.coalesce(F.concat(F.lit(f' {key}="'), escaped(value.cast("string")), F.lit('"')), F.lit("")))
    return F.concat(*parts, F.lit("/>")) if inner is None else F.concat(*parts, F.lit(">"), inner, F.lit(f"</{name}>"))


def _named(name: str, value: Column) -> Column:
    return _tag(name, {}, _tag("text", {}, escaped(value.cast("string"))))


def pnml_documents(places: DataFrame, transitions: DataFrame, arcs: DataFrame) -> DataFrame:
    """net_id, pnml: a document a net, its nodes in the order of their ids. The net's id stands in it, as text. A net is as large as a model: its document is one row.

    Rows with a null id are no nodes, and a name that is null is the id. A net has a document if it has a place or a transition.
    """
    def tokens(name):
        return F.when(F.col(name.removesuffix("Marking")) > 0, _named(name, F.col(name.removesuffix("Marking")))).otherwise("")

    node = lambda key: _named("name", F.coalesce(F.col("name"), F.col(key).cast("string")))
    silent = F.coalesce(F.col("silent"), F.lit(False))
    mark = F.when(silent, F.lit(f'<toolspecific tool="{PROM_TOOL}" version="6.4" activity="$invisible$"/>')).otherwise("")
    weight = F.when(F.col("weight") != 1.0, _tag("toolspecific", {"tool": F.lit(WEIGHT_TOOL), "version": F.lit("0.2"), "weight": F.col("weight").cast("double")})).otherwise("")
    attributes = {"id": F.col("tid"), "invisible": F.when(silent, F.lit("true")), "guard": F.when(F.col("guard") != "true", F.col("guard"))}
    rows = [
        places.where("pid IS NOT NULL").select("net_id", F.lit(0).alias("kind"), F.col("pid").cast("string").alias("a"), F.lit("").alias("b"),
                                               _tag("place", {"id": F.col("pid")}, F.concat(node("pid"), tokens("initialMarking"), tokens("finalMarking"))).alias("text")),
        transitions.where("tid IS NOT NULL").select("net_id", F.lit(1).alias("kind"), F.col("tid").cast("string").alias("a"), F.lit("").alias("b"),
                                                    _tag("transition", attributes, F.concat(node("tid"), F.coalesce(mark, F.lit("")), F.coalesce(weight, F.lit("")))).alias("text")),
        arcs.where("source IS NOT NULL AND target IS NOT NULL").select("net_id", F.lit(2).alias("kind"), F.col("source").cast("string").alias("a"), F.col("target").cast("string").alias("b"),
                                                                       _tag("arc", {"source": F.col("source"), "target": F.col("target")}).alias("text")),
    ]
    whole = rows[0].unionByName(rows[1]).unionByName(rows[2]).groupBy("net_id").agg(F.array_sort(F.collect_list(F.struct("kind", "a", "b", "text"))).alias("nodes"))
    whole = whole.where(F.exists("nodes", lambda x: x["kind"] < 2))
    arcs_named = F.transform("nodes", lambda x, i: F.when(x["kind"] < 2, x["text"]).otherwise(F.replace(x["text"], F.lit("<arc "), F.concat(F.lit('<arc id="arc'), i.cast("string"), F.lit('" ')))))
    page = _tag("page", {"id": F.lit("n0")}, F.array_join(arcs_named, "\n"))
    return whole.select("net_id", _tag("pnml", {}, _tag("net", {"id": F.col("net_id"), "type": F.lit(NET_TYPE)}, page)).alias("pnml"))


def write_nets(path: str, places: DataFrame, transitions: DataFrame, arcs: DataFrame, mode: str = "errorifexists") -> None:
    """A folder of files, each of many documents."""
    pnml_documents(places, transitions, arcs).select("pnml").write.mode(mode).text(path)


def read_nets(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """places, transitions and arcs of all documents in files and folders, which may hold one or many each. net_id is the net's own id.

    Files are cut where a document ends, so large ones are read in parts. The outermost tag must be named pnml, without a prefix.
    """
    texts = spark.read.option("lineSep", "</pnml>").text(path).where("contains(value, '<pnml')")
    texts = texts.select(F.concat(F.regexp_replace("value", "^[^<]*(<[?!][^>]*>[^<]*)*", ""), F.lit("</pnml>")).alias("pnml"))
    return _tables(texts.select(F.from_xml("pnml", DOCUMENT)["net"][0].alias("net")).select(F.col("net._id").alias("net_id"), "net"))


def nets_of(documents: DataFrame) -> dict[str, DataFrame]:
    """places, transitions and arcs of rows (net_id, pnml). A text that is no document is a net without nodes."""
    return _tables(documents.select("net_id", F.from_xml("pnml", DOCUMENT)["net"][0].alias("net")))


def _tokens(lists: Column, own: Column, pid: Column) -> Column:
    """A place's tokens: its own, else those of the first marking of the net's list."""
    listed = F.filter(lists["marking"][0]["place"], lambda x: x["_idref"] == pid)
    return F.coalesce(own.try_cast("int"), F.get(listed, F.lit(0))["text"].try_cast("int"), F.lit(0))


def _tables(parsed: DataFrame) -> dict[str, DataFrame]:
    """Of the first page of a net, or of the net itself if it has none."""
    names = ["place", "transition", "arc"]
    page = F.col("net.page")[0]
    rows = parsed.select("net_id", *[F.when(page.isNotNull(), page[n]).otherwise(F.col(f"net.{n}")).alias(n) for n in names],
                         *[F.coalesce(F.col(f"net.{n}"), page[n]).alias(n) for n in ("initialmarkings", "finalmarkings")])
    rows = written(rows, "nets")
    p = rows.select("net_id", "initialmarkings", "finalmarkings", F.explode("place").alias("x"))
    own = F.col("x._id")
    places = p.select("net_id", own.alias("pid"), F.coalesce(F.col("x.name.text"), own).alias("name"),
                      _tokens(F.col("initialmarkings"), F.col("x.initialMarking.text"), own).alias("initial"), _tokens(F.col("finalmarkings"), F.col("x.finalMarking.text"), own).alias("final"))
    t = rows.select("net_id", F.explode("transition").alias("x"))
    tools = F.coalesce(F.col("x.toolspecific"), F.array().cast(_TOOLS))
    silent = (F.lower(F.coalesce(F.col("x._invisible"), F.lit(""))) == "true") | F.exists(tools, lambda s: F.coalesce(s["_activity"] == "$invisible$", F.lit(False)))
    weighs = F.filter(tools, lambda s: s["_tool"] == WEIGHT_TOOL)
    told = F.filter(F.flatten(F.transform(weighs, lambda s: F.coalesce(s["property"], F.array().cast("array<struct<_key:string,_VALUE:string>>")))), lambda x: x["_key"] == "weight")
    weight = F.coalesce(F.try_element_at(told, F.lit(-1))["_VALUE"].try_cast("double"), F.try_element_at(weighs, F.lit(-1))["_weight"].try_cast("double"), F.lit(1.0))
    transitions = t.select("net_id", F.col("x._id").alias("tid"), F.coalesce(F.col("x.name.text"), F.col("x._id")).alias("name"), silent.alias("silent"), weight.alias("weight"),
                           F.coalesce(F.col("x._guard"), F.lit("true")).alias("guard"))
    arcs = rows.select("net_id", F.explode("arc").alias("x")).select("net_id", F.col("x._source").alias("source"), F.col("x._target").alias("target"))
    return {"places": places, "transitions": transitions, "arcs": arcs}
