"""The rounds of mixture fits as a function of the JVM (``MixtureRounds.java``).

Spark's own compiler, which every Spark has for its generated code, compiles the source once for
each application; the classes go to the executors as an added jar. Where that isn't possible,
numpy does the same rounds, only slower (``mixture.fit_many``).
"""

from __future__ import annotations

import logging
import pkgutil
import tempfile
import zipfile

from py4j.protocol import Py4JError
from pyspark.sql import SparkSession

SOURCE, CLASS, NAME = "MixtureRounds.java", "basewise.MixtureRounds", "basewise_mixture_rounds"
_log = logging.getLogger(__name__)
_objects: dict[str, object] = {}


def _object(spark: SparkSession) -> object:
    """An object of the class, whose jar the application has."""
    sc = spark.sparkContext
    compiler = sc._jvm.org.codehaus.janino.SimpleCompiler()
    compiler.setParentClassLoader(sc._jvm.Thread.currentThread().getContextClassLoader())
    compiler.cook(pkgutil.get_data(__package__, SOURCE).decode())
    classes = compiler.getBytecodes()
    path = f"{tempfile.mkdtemp(prefix='basewise-classes-')}/basewise-classes.jar"
    with zipfile.ZipFile(path, "w") as jar:
        for name in classes:
            jar.writestr(f"{name.replace('.', '/')}.class", bytes(classes[name]))
    sc._jsc.addJar(path)
    none = sc._gateway.new_array(sc._jvm.Object, 0)
    return compiler.getClassLoader().loadClass(CLASS).getConstructors()[0].newInstance(none)


def registered(spark: SparkSession) -> str | None:
    """The name of the SQL function of packed parts and settings; ``None`` where it can't be had."""
    try:
        application = spark.sparkContext.applicationId
        if application not in _objects:
            _objects[application] = _object(spark)
        spark._jsparkSession.udf().register(NAME, _objects[application], spark.sparkContext._jvm.org.apache.spark.sql.types.DataTypes.BinaryType)
    except (Py4JError, OSError, TypeError, AttributeError) as e:
        _log.warning("%s isn't compiled, mixtures are fitted with numpy, which is slower: %s", SOURCE, e)
        return None
    return NAME
