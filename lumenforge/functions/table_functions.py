"""Table functions for SQL: `SELECT .. FROM f(TABLE(t) PARTITION BY key ORDER BY ..)`."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf

from ..sources.shared import open_path
from ..sources.tar_shards import _Window, walk


@udtf(returnType="conv_id long, turn long, role string, text string, history array<string>")
class PrefixTurns:
    """Each turn of a conversation with all turns before it, `role: text` each; wants (conv_id, turn, role, text) partitioned by conv_id, ordered by turn.

    A conversation's turns so far are held, which are what its last row returns.
    """

    def __init__(self) -> None:
        self.before: list[str] = []

    def eval(self, row: Row) -> Iterator[tuple]:
        yield row["conv_id"], row["turn"], row["role"], row["text"], list(self.before)
        self.before.append(f"{row['role']}: {row['text']}")


@udtf(returnType="path string, member string, size long, content binary, error string")
class LoadMembers:
    """Members of the archives whose paths a table has in its column path (S07); an archive that can't be opened is a row with an error."""

    def eval(self, row: Row) -> Iterator[tuple]:
        path = row["path"]
        if path is None:
            return
        try:
            fs, at = open_path(path)
            file = fs.open_input_file(at)
        except OSError as e:
            yield path, None, None, None, str(e)
            return
        with file:
            window = _Window(file)
            for m in walk(file, window=window):
                yield path, m.name, m.size, None if m.error else window.read(m.data_at, m.size), m.error


def register(spark: SparkSession) -> None:
    """prefix_turns and load_members, for the session's SQL."""
    spark.udtf.register("prefix_turns", PrefixTurns)
    spark.udtf.register("load_members", LoadMembers)
