"""Pack token sequences: concatenate all documents and cut every SEQUENCE_TOKENS ids.

Pass one tokenises each partition, notes where every document starts inside its
partition, and writes the ids. Prefix sums over the partition totals (one row for
each partition) turn these into global offsets. Pass two cuts at fixed windows; a
document that crosses a boundary leaves a record on either side.
"""

import base64
import re
import struct

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from tidewatch.llm.common import map_rows
from tidewatch.session import materialize

SEQUENCE_TOKENS = 1024
END_ID = 0
#: Pieces kept, and characters of the longest one kept: repeated pieces are short, rare ones may be of any length.
CACHE_PIECES, CACHE_CHARACTERS = 400_000, 64

# The splitting rule of the vocabulary, for texts below U+0250 whose letters and digits can be listed.
LETTERS, DIGITS = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼-¾"
SPLIT = (rf"'(?:s|t|re|ve|m|ll|d)| ?[{LETTERS}]+| ?[{DIGITS}]+"
         rf"| ?[^\s{LETTERS}{DIGITS}]+|\s+(?!\S)|\s+")
#: White space for Python but not for the vocabulary's rule, and everything from U+0250 on.
RARE = "[\x1c-\x1fɐ-\U0010ffff]"


class Tokenizer:
    """Ids of a byte-level BPE file, by ``tokenizers``.

    Repeated pieces are the bulk of any text, so pieces are encoded once and kept (up to
    CACHE_PIECES). With the same vocabulary as ranks, new pieces go through
    ``tiktoken``, which gives the same ids at a quarter of the time. Texts with
    characters from U+0250 on, or with a special token's name, go through
    ``tokenizers`` whole.
    """

    def __init__(self, path: str, ranks: str | None = None):
        import tokenizers
        self.whole = tokenizers.Tokenizer.from_file(path)
        special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.rare = re.compile("|".join([RARE, *map(re.escape, special)]))
        self.split = re.compile(SPLIT).findall
        self.pieces: dict[str, bytes] = {}
        self.width = "<u2" if self.whole.get_vocab_size() <= 1 << 16 else "<u4"
        self.quick = None
        if ranks:
            import tiktoken
            with open(ranks, "rb") as lines:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.quick = tiktoken.Encoding("ranks", pat_str=SPLIT_ALL, mergeable_ranks=table, special_tokens={})

    def encode(self, text: str) -> bytes:
        """Ids as little-endian numbers of ``width``."""
        if self.rare.search(text):
            return self.packed(self.whole.encode(text, add_special_tokens=False).ids)
        if len(self.pieces) > CACHE_PIECES:
            self.pieces.clear()
        known, out = self.pieces, []
        for piece in self.split(text):
            ids = known.get(piece)
            if ids is None:
                ids = self.packed(
                    self.quick.encode_ordinary(piece) if self.quick
                    else self.whole.encode(piece, add_special_tokens=False).ids)
                if len(piece) <= CACHE_CHARACTERS:
                    known[piece] = ids
            out.append(ids)
        return b"".join(out)

    def packed(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{'H' if self.width == '<u2' else 'I'}", *ids)


SPLIT_ALL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def tokenised(docs: DataFrame, path: str, ranks: str | None, id: str, text: str) -> DataFrame:
    """(part, doc_id, start in the part, tokens, width, ids), the end id included, as a written table."""
    id_type = docs.schema[id].dataType.simpleString()
    narrow = docs.select(F.spark_partition_id().alias("part"), F.col(id).alias("doc_id"), F.col(text).alias("text"))

    def rows(batch):
        tokenizer, start = None, 0
        for part, doc_id, value in batch:
            tokenizer = tokenizer or Tokenizer(path, ranks)
            size = np.dtype(tokenizer.width).itemsize
            ids = tokenizer.encode(value or "") + END_ID.to_bytes(size, "little")
            count = len(ids) // size
            yield part, doc_id, start, count, size, ids
            start += count

    return materialize(map_rows(
        narrow, rows, f"part int, doc_id {id_type}, start long, tokens long, width int, ids binary"), "token-ids")


def pack(docs: DataFrame, path: str, ranks: str | None = None, sequence: int = SEQUENCE_TOKENS,
         id: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids (binary, unsigned 32-bit little-endian),
    doc_tokens, sequence_id, offset.

    Every id lies in exactly one piece; all sequences but the last are full. Null and
    empty texts are one end id. Repeated rows are packed each. A text of any length
    becomes as many pieces as it needs. An empty table gives no pieces.
    """
    stored = tokenised(docs, path, ranks, id, text)
    # One row for each partition of the input: the only data ordered in one task, and broadcast.
    totals = stored.groupBy("part").agg(F.sum("tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    placed = (stored.join(F.broadcast(bases), "part")
              .select("doc_id", (F.col("base") + F.col("start")).alias("at"), "tokens", "width", "ids"))

    def cut(batch):
        for doc_id, at, tokens, width, ids in batch:
            wide = np.frombuffer(ids, dtype="<u2" if width == 2 else "<u4").astype("<u4")
            done = 0
            while done < tokens:
                number, offset = divmod(at + done, sequence)
                length = min(sequence - offset, tokens - done)
                yield doc_id, done, length, wide[done:done + length].tobytes(), tokens, number, offset
                done += length

    return map_rows(placed, cut, f"doc_id {docs.schema[id].dataType.simpleString()}, start long, length long, "
                                 "ids binary, doc_tokens long, sequence_id long, offset long")
