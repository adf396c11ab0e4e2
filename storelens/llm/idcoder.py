"""The token-id coder: ``IdCoder.java``, compiled by Spark's own compiler and run in the executors.

A context-mixing coder makes some hundred operations for each id, one after another, so it runs in
the JVM beside Spark's generated code.  Janino, the compiler that Spark uses for that code, compiles
it on the driver; the classes travel as a jar of a few kilobytes that Spark hands to each executor,
and two SQL functions call them:

* ``storelens_encode_ids(binary)``: little-endian unsigned 32-bit ids to blocks, one after another;
* ``storelens_decode_ids(binary)``: back; fails where a block is damaged.

An empty binary gives an empty one; a null gives an error.
"""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

SOURCE = Path(__file__).with_name("IdCoder.java")
FUNCTIONS = {"storelens_encode_ids": "storelens.IdCoder$Encode", "storelens_decode_ids": "storelens.IdCoder$Decode"}


def _loader(spark: SparkSession):
    """The class loader with the coder, once for each context; its classes are handed to all executors."""
    context = spark.sparkContext
    loader = getattr(context, "_storelens_coder", None)
    if loader is None:
        compiler = spark._jvm.org.codehaus.janino.SimpleCompiler()
        compiler.cook(SOURCE.read_text())
        target = Path(tempfile.mkdtemp(prefix="storelens-")) / "storelens-ids.jar"
        with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as jar:
            for name, code in compiler.getBytecodes().items():
                jar.writestr(name.replace(".", "/") + ".class", bytes(code))
        context._jsc.addJar(str(target))
        loader = context._storelens_coder = compiler.getClassLoader()
    return loader


def registered(spark: SparkSession) -> SparkSession:
    """``spark``, with both functions."""
    loader = _loader(spark)
    binary = spark._jvm.org.apache.spark.sql.types.DataTypes.BinaryType
    for name, kind in FUNCTIONS.items():
        if not spark.catalog.functionExists(name):
            spark._jsparkSession.udf().register(name, loader.loadClass(kind).newInstance(), binary)
    return spark


def encoded(ids: Column) -> Column:
    return F.call_function("storelens_encode_ids", ids)


def decoded(blocks: Column) -> Column:
    return F.call_function("storelens_decode_ids", blocks)


def on_driver(spark: SparkSession, name: str, raw: bytes) -> bytes:
    """One of the functions on bytes of the driver, for tools and tests."""
    return bytes(_loader(spark).loadClass(FUNCTIONS[name]).newInstance().call(bytearray(raw)))
