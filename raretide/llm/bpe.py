"""Byte-level BPE encoding and decoding through a sentencepiece model written from a rank file.

The rank file alone defines the model: every token becomes one piece, its bytes written as printable characters,
its score the negative rank, its id the rank. Normalisation is the identity. Each match of the pre-tokenizer's
pattern is encoded on its own, ids are decoded through the inverse byte mapping.
"""

from __future__ import annotations

import base64
import hashlib
import re

import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame

from raretide.llm.common import small_batches, texts

# Distinct pre-tokens a Python worker remembers; the rest are encoded again when met again.
REMEMBERED = 200_000

# The letters, numbers and white space among the characters below U+0250. Texts with other
# characters than these, general punctuation and the euro sign are split by the full pattern instead.
_LETTER = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
_NUMBER = "0-9²³¹¼½¾"
_BLANK = "\t-\r \x85\xa0  "
_PLAIN = re.compile(
    f" ?[{_LETTER}]+|'(?:[stmd]|re|ve|ll)| ?[{_NUMBER}]+| ?[^{_BLANK}{_LETTER}{_NUMBER}]+|[{_BLANK}]+(?![^{_BLANK}])|[{_BLANK}]+"
)
_NOT_PLAIN = re.compile("[ɐ-‏  -₫₭-\U0010ffff]")

# Code points that the regex module's newer Unicode tables call letters or numbers and tiktoken's do not.
_LATE_LETTERS = (
    "0558 058B-058C 088F 0C5C 0CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959 "
    "10EC5-10EC7 10ED9-10EEE 11B0A 11DB0-11DDB 11DF1 16EA0-16EB8 16EBB-16ED3 16FF2-16FF3 187F8-187FF 18CD6-18CDA "
    "18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 "
    "1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD "
    "323B0-33479 3D000-3FC3F"
)
_LATE_NUMBERS = "11DE0-11DE9 1246F 12475-1247F 12550-12686 16FF4-16FF6"
_LATE = re.compile("[" + "".join(
    "-".join(chr(int(end, 16)) for end in span.split("-")) for span in f"{_LATE_LETTERS} {_LATE_NUMBERS}".split()) + "]")
_OTHER = "\ufffd"  # neither letter nor number nor white space


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def byte_characters() -> list[str]:
    """For each byte a printable character: itself where Latin-1 prints it, else the next free one from U+0100."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return [chr(b) if b in set(printable) else chr(0x100 + others.index(b)) for b in range(256)]


def write_model(ranks: dict[bytes, int]) -> bytes:
    """A serialised sentencepiece BPE model: piece id = rank, score = -rank, one unknown piece at the end."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    if sorted(ranks.values()) != list(range(len(ranks))):
        raise ValueError("ranks must run from 0 without gaps")
    chars = byte_characters()
    model = pb.ModelProto()
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        model.pieces.add(piece="".join(chars[b] for b in token), score=-float(rank), type=pb.ModelProto.SentencePiece.NORMAL)
    model.pieces.add(piece="<unk>", score=-float(len(ranks)), type=pb.ModelProto.SentencePiece.UNKNOWN)
    t, n = model.trainer_spec, model.normalizer_spec
    t.model_type = pb.TrainerSpec.BPE
    t.unk_id, t.bos_id, t.eos_id, t.pad_id = len(ranks), -1, -1, -1
    t.vocab_size = len(model.pieces)
    n.name = "identity"
    n.add_dummy_prefix = n.remove_extra_whitespaces = n.escape_whitespaces = False
    return model.SerializeToString()


class Codec:
    """Encodes and decodes texts; one per Python worker."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.sp = sentencepiece.SentencePieceProcessor(model_proto=write_model(ranks))
        self.full = regex.compile(pattern)
        self.plain = _PLAIN
        self.chars = {b: c for b, c in enumerate(byte_characters())}
        self.bytes_of = {str(rank): token for token, rank in ranks.items()}
        self.known: dict[str, str] = {}

    def split(self, text: str) -> list[str]:
        if not _NOT_PLAIN.search(text):
            return self.plain.findall(text)
        if not _LATE.search(text):
            return self.full.findall(text)
        return [text[m.start():m.end()] for m in self.full.finditer(_LATE.sub(_OTHER, text))]

    def learn(self, pieces: set[str]) -> None:
        """Encode pre-tokens that are not remembered, all in one call."""
        found: list[str] = []
        for p in pieces:
            rank = self.ranks.get(p.encode("utf-8"))
            if rank is None:
                found.append(p)
            else:
                self.known[p] = str(rank)
        mapped = [p.encode("utf-8").decode("latin-1").translate(self.chars) for p in found]
        for p, ids in zip(found, self.sp.encode(mapped, num_threads=1), strict=True):
            self.known[p] = " ".join(map(str, ids))

    def encode_batch(self, batch: list[str]) -> list[str]:
        """The decimal ids of each text, joined by one space."""
        split = [self.split(t) for t in batch]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        self.learn({p for pieces in split for p in pieces if p not in self.known})
        return [" ".join(map(self.known.__getitem__, pieces)) for pieces in split]

    def decode(self, ids: list[str]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def encode_decode(docs: DataFrame, ranks_path: str, pattern: str, id_column: str = "doc_id", text_column: str = "text",
                  with_ids: bool = False) -> DataFrame:
    """Encode every whole text and decode the ids again: one map over the table, no shuffle.

    Per row: the id, ``n_tokens``, ``ids_sha256`` (hex digest of the decimal ids joined by one space),
    ``decoded_sha256`` (hex digest of the decoded bytes) and, ``with_ids``, the ids as ``token_ids``. A null text is
    encoded as the empty one: 0 tokens and the digests of nothing. Rows are neither merged nor dropped; repeated
    rows and null ids come back as they are, other columns are not read, an empty table gives an empty result.

    ``ranks_path`` must be readable by every worker (the vocabulary is installed there, it is not in this package).
    """
    schema = f"{id_column} bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    schema += ", token_ids array<int>" if with_ids else ""

    def run(batches):
        codec = Codec(read_ranks(ranks_path), pattern)
        for batch in small_batches(batches):
            rows: list[list] = [[], [], [], []]
            tokens: list[list[int]] = []
            for joined in codec.encode_batch(texts(batch, text_column)):
                ids = joined.split(" ") if joined else []
                rows[1].append(len(ids))
                rows[2].append(hashlib.sha256(joined.encode()).hexdigest())
                rows[3].append(hashlib.sha256(codec.decode(ids)).hexdigest())
                if with_ids:
                    tokens.append([int(i) for i in ids])
            columns = [batch.column(id_column).cast(pa.int64()), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.string()),
                       pa.array(rows[3], pa.string())]
            names = [id_column, "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns.append(pa.array(tokens, pa.list_(pa.int32())))
                names.append("token_ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select(id_column, text_column).mapInArrow(run, schema)
