"""Small files and folders in whatever file system a path names, from the driver."""

import threading
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

_ONE_AT_A_TIME = threading.Lock()


class Folder:
    """A folder of a Hadoop file system; it need not exist yet."""

    def __init__(self, spark: SparkSession, path: str):
        self._jvm, self.path = spark._jvm, path
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self._at().getFileSystem(self._conf)

    def _at(self, name: str = ""):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self) -> list[str]:
        """Names inside, sorted; hidden ones are left out."""
        if not self._fs.exists(self._at()):
            return []
        found = [status.getPath().getName() for status in self._fs.listStatus(self._at())]
        return sorted(name for name in found if name[0] not in "._")

    def has(self, name: str) -> bool:
        return self._fs.exists(self._at(name))

    def read(self, name: str) -> str | None:
        if not self.has(name):
            return None
        stream = self._fs.open(self._at(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        """Replaces what is there."""
        stream = self._fs.create(self._at(name), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def publish(self, name: str, text: str) -> bool:
        """Create a file unless it exists, with its whole content from the first moment on.

        A rename that does not replace: atomic on HDFS, and guarded within one driver for
        local folders. Object stores without such a rename are not supported.
        """
        made = f"_{uuid.uuid4().hex}"
        self.write(made, text)
        options = getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename")
        none = self._jvm.java.lang.reflect.Array.newInstance(options._java_lang_class, 0)
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._at().toUri(), self._conf)
        try:
            with _ONE_AT_A_TIME:
                context.rename(context.makeQualified(self._at(made)), context.makeQualified(self._at(name)), none)
            return True
        except Py4JJavaError as error:
            if "FileAlreadyExistsException" not in error.java_exception.getClass().getName():
                raise
            return False
        finally:
            self.remove(made)

    def remove(self, name: str) -> None:
        if self.has(name):
            self._fs.delete(self._at(name), True)

    def numbers(self, prefix: str, finished: bool = True) -> list[int]:
        """Numbers of the subfolders ``prefix<number>``, in order; those a job has finished writing, if wanted."""
        found = [name for name in self.names() if name.startswith(prefix) and name[len(prefix):].isdigit()]
        return sorted(int(name[len(prefix):]) for name in found if not finished or self.has(f"{name}/_SUCCESS"))
