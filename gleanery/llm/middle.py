"""Fill-in-the-middle: cuts at lines found by a Fenwick tree over fixed blocks of a text."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import text_or_empty

#: Bytes of text that one leaf of the tree stands for.
BLOCK = 4096
#: Marks before prefix, suffix and middle.
SENTINELS = ("<P>", "<S>", "<M>")
CUT = "n long, prefix_chars long, middle_chars long, output string"


class BlockTree:
    """Line ends and code points of a text by blocks of its UTF-8 bytes, as Fenwick trees.

    ``tree[i]`` holds the counts of the ``i & -i`` blocks up to block i, so a
    descent by powers of two finds the block in which a line ends in as
    many steps as the number of blocks has bits; only that block is scanned.
    """

    def __init__(self, raw: bytes, block: int = BLOCK):
        self.raw, self.block = raw, block
        data = np.frombuffer(raw, dtype=np.uint8)
        starts = np.arange(0, len(data), block)
        counts = np.zeros((len(starts) + 1, 2), dtype=np.int64)
        if len(data):
            counts[1:, 0] = np.add.reduceat(data == 10, starts, dtype=np.int64)
            counts[1:, 1] = np.add.reduceat((data & 0xC0) != 0x80, starts, dtype=np.int64)
        upto = counts.cumsum(axis=0)
        at = np.arange(len(upto))
        self.tree = (upto - upto[at - (at & -at)]).tolist()
        self.ends, self.chars = upto[-1].tolist()
        #: A last line without a line end is a unit too.
        self.n = self.ends + (len(raw) > 0 and raw[-1:] != b"\n")

    def cut(self, units: int) -> tuple[int, int]:
        """(byte, code points before it) of the place after so many units."""
        if units <= 0:
            return 0, 0
        if units > self.ends:
            return len(self.raw), self.chars
        at, left, chars, step = 0, units, 0, 1 << (len(self.tree) - 1).bit_length()
        while step:
            if at + step < len(self.tree) and self.tree[at + step][0] < left:
                at += step
                left -= self.tree[at][0]
                chars += self.tree[at][1]
            step >>= 1
        lo = at * self.block
        data = np.frombuffer(self.raw, dtype=np.uint8, count=min(self.block, len(self.raw) - lo), offset=lo)
        stop = int(np.flatnonzero(data == 10)[left - 1]) + 1
        return lo + stop, chars + int(((data[:stop] & 0xC0) != 0x80).sum())


def cut_texts(texts: pd.Series, h1: pd.Series, h2: pd.Series, forms: pd.Series, marks: pd.Series) -> pd.DataFrame:
    rows = []
    for text, a, b, form, names in zip(texts, h1, h2, forms, marks):
        raw = text.encode("utf-8", "surrogatepass")
        tree = BlockTree(raw)
        if form == "plain":
            rows.append((tree.n, None, None, text))
            continue
        p, s, m = names
        (first, prefix_chars), (second, upto) = map(tree.cut, sorted((int(a) % (tree.n + 1), int(b) % (tree.n + 1))))
        prefix, middle, suffix = (x.decode("utf-8", "surrogatepass") for x in (raw[:first], raw[first:second], raw[second:]))
        output = f"{p}{prefix}{s}{suffix}{m}{middle}" if form == "psm" else f"{s}{suffix}{p}{prefix}{m}{middle}"
        rows.append((tree.n, prefix_chars, upto - prefix_chars, output))
    out = pd.DataFrame(rows, columns=["n", "prefix_chars", "middle_chars", "output"])
    return out.astype({"n": "int64", "prefix_chars": "Int64", "middle_chars": "Int64"})


def fill_in_middle(
    docs: DataFrame, seed: int = 7, percent: int = 100, spm_percent: int = 50, sentinels: tuple[str, str, str] = SENTINELS, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()
) -> DataFrame:
    """Each text cut at two line ends and put in prefix-suffix-middle or suffix-prefix-middle order.

    Returns doc_id, the columns named in ``keep``, n (lines), form (``psm``,
    ``spm`` or ``plain``), prefix_chars, middle_chars (code points; null if
    plain) and output.  Where to cut and which form follows from sha256 of
    ``seed:doc_id`` alone, so reruns and other partitionings agree, and no row is
    shuffled.  A text that is empty or holds a sentinel stays plain, and so do
    those beyond ``percent``.

    A null text is an empty one; a null id counts as an empty string in
    the hash; rows with one id are cut at the same shares.  Other columns of
    ``docs``, whatever their names, have no effect.
    """
    ident = F.col("doc_id").cast("string")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(ident, F.lit(""))), 256)
    h1, h2, h3, h4 = (F.conv(F.substring(digest, k, 8), 16, 10).cast("long") for k in (1, 9, 17, 25))
    p, s, m = (F.contains("text", F.lit(x)) for x in sentinels)
    plain = (F.col("text") == "") | p | s | m | (h3 % 100 >= percent)
    form = F.when(plain, "plain").when(h4 % 100 < spm_percent, "spm").otherwise("psm")
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"), *keep)
    cut = F.pandas_udf(cut_texts, CUT)("text", h1, h2, form, F.array(*map(F.lit, sentinels)))
    return rows.select("doc_id", *keep, form.alias("form"), cut.alias("cut")).select("doc_id", *keep, "cut.n", "form", "cut.prefix_chars", "cut.middle_chars", "cut.output")


def restored(form: Column, output: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text from which ``output`` was made: each sentinel stands once, and none can arise where parts meet."""
    p, s, m = sentinels
    head, middle = F.substring_index(output, m, 1), F.substring_index(output, m, -1)
    psm = F.concat(F.substring_index(F.substring(head, len(p) + 1, 2**31 - 1), s, 1), middle, F.substring_index(head, s, -1))
    spm = F.concat(F.substring_index(head, p, -1), middle, F.substring_index(F.substring(head, len(s) + 1, 2**31 - 1), p, 1))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def digests(cut: DataFrame, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """The outputs as hashes, beside those of the texts rebuilt from them."""
    back = restored(F.col("form"), F.col("output"), sentinels)
    return cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


ORACLE_SQL = r"""
WITH units AS (
    SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS parts,
           sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h
    FROM documents
), dealt AS (
    SELECT *, len(parts)::BIGINT AS n, ('0x' || h[1:8])::BIGINT % (len(parts) + 1) AS a, ('0x' || h[9:16])::BIGINT % (len(parts) + 1) AS b,
           CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR ('0x' || h[17:24])::BIGINT % 100 >= 100 THEN 'plain'
                WHEN ('0x' || h[25:32])::BIGINT % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
    FROM units
), cut AS (
    SELECT *, array_to_string(parts[1:least(a, b)], '') AS prefix, array_to_string(parts[least(a, b) + 1:greatest(a, b)], '') AS middle,
           array_to_string(parts[greatest(a, b) + 1:], '') AS suffix
    FROM dealt
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle)::BIGINT END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM cut
"""
