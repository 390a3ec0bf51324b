"""The rounds of Baum-Welch in Java, compiled by the compiler that Spark brings."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path
from weakref import WeakKeyDictionary

import numpy as np
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

ROWS = "array<struct<range:int,at:binary,near:binary,far:binary,own:binary,mask:binary>>"
LANES = 4  # doubles of a vector
_HEADS = {
    "step": "double[] kept, int now, double[] move, double[] seen, int at",
    "meet": "double[] kept, int now, double[] seen, int at, double[] later, double scale, double[] coming",
    "back": "double[] kept, int before, double[] coming, double[] sums, double[] turned, double[] later",
    "copy": "double[] x, int from, double[] out, int at",
    "add": "double[] x, int from, double[] out, int at",
}
_classes: WeakKeyDictionary = WeakKeyDictionary()


def _vectors(states: int, fast: bool) -> str:
    """The steps of BaumWelch.java in vectors, held in variables; empty if not fast."""
    parts, load, body = range(0, states, LANES), "DoubleVector.fromArray(P, {}, {})".format, dict.fromkeys(_HEADS, "")
    every = lambda text: "".join(text.replace("#", str(p)) for p in parts)

    def product(x: str, at: str, m: str) -> str:
        """s0, s4, ...: the rows of m weighted by x."""
        first = f"a = DoubleVector.broadcast(P, {x}[{at}]);\n" + every(f"DoubleVector s# = {load(m, '#')}.mul(a);\n")
        return first + "".join(
            f"a = DoubleVector.broadcast(P, {x}[{at} + {i}]);\n"
            + "".join(f"s{p} = {load(m, i * states + p)}.fma(a, s{p});\n" for p in parts) for i in range(1, states))

    if fast:
        body["step"] = "DoubleVector a;\n" + product("kept", f"now - {states}", "move") + every(
            f"s#.mul({load('seen', 'at + #')}).intoArray(kept, now + #);\n")
        body["meet"] = every(
            f"DoubleVector l# = {load('later', '#')};\n"
            f"{load('seen', 'at + #')}.mul(l#).mul(scale).intoArray(coming, #);\n"
            f"{load('kept', 'now + #')}.mul(l#).intoArray(seen, at + #);\n")
        body["back"] = "DoubleVector a;\n" + every(f"DoubleVector c# = {load('coming', '#')};\n") + "".join(
            f"a = DoubleVector.broadcast(P, kept[before + {i}]);\n" + "".join(
                f"c{p}.fma(a, {load('sums', i * states + p)}).intoArray(sums, {i * states + p});\n" for p in parts)
            for i in range(states)) + product("coming", "0", "turned") + every("s#.intoArray(later, #);\n")
        body["copy"] = every(f"{load('x', 'from + #')}.intoArray(out, at + #);\n")
        body["add"] = every(f"{load('out', 'at + #')}.add({load('x', 'from + #')}).intoArray(out, at + #);\n")
    return ("class BaumWelchFast {\n" + "static final VectorSpecies P = DoubleVector.SPECIES_256;\n" * fast
            + "".join(f"static void {name}({_HEADS[name]}) {{\n{text}}}\n" for name, text in body.items()) + "}\n")


def _compiled(spark: SparkSession, states: int, scaled: int):
    """The class, for so many states; executors get it as a jar."""
    known = _classes.setdefault(spark.sparkContext, {})
    if (states, scaled) in known:
        return known[states, scaled]
    name = f"BaumWelch{states}_{scaled}"
    source = Path(__file__).with_name("BaumWelch.java").read_text()
    source = source.replace("@STATES@", str(states)).replace("@SCALED@", str(scaled))
    cook = spark._jvm.org.codehaus.janino.SimpleCompiler
    for fast in [True] * (states % LANES == 0 and states <= 4 * LANES) + [False]:
        text = source.replace("@FAST@", str(fast).lower())
        text = ("import jdk.incubator.vector.*;\n" * fast + text + _vectors(states, fast)).replace("BaumWelch", name)
        compiler = cook()
        try:
            compiler.cook(text)
            break
        except Exception:  # no vectors here
            if not fast:
                raise
    file = tempfile.NamedTemporaryFile(prefix=name, suffix=".jar", dir=_scratch(spark), delete=False)
    with file, zipfile.ZipFile(file, "w") as jar:
        for entry in compiler.getBytecodes().entrySet():
            jar.writestr(entry.getKey().replace(".", "/") + ".class", bytes(entry.getValue()))
    spark._jvm.java.io.File(file.name).deleteOnExit()
    spark._jsc.addJar(file.name)
    known[states, scaled] = compiler.getClassLoader().loadClass(name)
    return known[states, scaled]


def _scratch(spark: SparkSession) -> str:
    """A folder of the driver's machine that Python and the JVM name alike."""
    return spark._jvm.java.lang.System.getProperty("java.io.tmpdir")


class Rounds:
    """``expect`` of a model: a function over the columns of a block, and what it gives."""

    def __init__(self, spark: SparkSession, model, even: np.ndarray, total: np.ndarray, prior: float,
                 local_range: int, lowest: int, scaled: int):
        jvm, (size, states) = spark._jvm, model.emit.shape
        made = _compiled(spark, states, scaled).getConstructors()[0]
        with tempfile.NamedTemporaryFile(dir=_scratch(spark)) as file:
            for x in (model.start, model.move, model.emit, even, total):
                np.ascontiguousarray(x, "<f8").tofile(file)
            file.flush()
            values = spark.sparkContext._gateway.new_array(jvm.java.lang.Object, 6)
            for i, x in enumerate((spark._jsc, file.name, size, local_range, lowest, float(prior))):
                values[i] = x
            self.shared = made.newInstance(values)
        self.spark, self.name = spark, f"baum_welch_{uuid.uuid4().hex}"
        spark._jsparkSession.udf().register(
            self.name, self.shared, jvm.org.apache.spark.sql.types.DataType.fromDDL(ROWS))

    def __call__(self, *columns: Column) -> Column:
        return F.call_function(self.name, *columns)

    def destroy(self) -> None:
        self.spark.sql(f"drop temporary function {self.name}")
        self.shared.destroy()
