"""Coordinate chunker and long-text splitter; resume filters."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.functions import lexicon
from lodestar.functions.text import canon_id_from_coord
from lodestar.session import attach

MIN_CHARS, MAX_CHARS, OVERLAP = 120, 600, 60


def split_long(text: str, most: int = MAX_CHARS, overlap: int = OVERLAP, delimiters: str = lexicon.DELIMITERS) -> list[str]:
    """Sentences packed up to `most`; without delimiters, windows of `most` that overlap."""
    if len(text) <= most:
        return [text]
    sentences = [s for s in re.split(f"(?<=[{re.escape(delimiters)}])", text) if s]
    if len(sentences) < 2:
        return [text[at : at + most] for at in range(0, len(text), most - overlap)]
    packed = [sentences[0]]
    for s in sentences[1:]:
        if len(packed[-1]) + len(s) <= most:
            packed[-1] += s
        else:
            packed.append(s)
    return packed


class Fold:
    """Segments of one file folded into pieces (chunk_no, piece_no, first coord, last coord, text).

    Segments are merged up to `most` characters and let go at `least`; a merged text longer than
    `most` is split. A short tail joins the last piece if it fits there. Only that piece and the
    segments being merged are held.
    """

    def __init__(self, least: int = MIN_CHARS, most: int = MAX_CHARS, overlap: int = OVERLAP, delimiters: str = lexicon.DELIMITERS) -> None:
        self.least, self.most, self.overlap, self.delimiters = least, most, overlap, delimiters
        self.chunk_no, self.last_piece = 0, None
        self.first = self.last = None
        self.held = ""

    def _emit(self, first: str, last: str, text: str) -> list[tuple]:
        pieces = [(self.chunk_no, k, first, last, p) for k, p in enumerate(split_long(text, self.most, self.overlap, self.delimiters))]
        self.chunk_no += 1
        out = [self.last_piece, *pieces[:-1]] if self.last_piece else pieces[:-1]
        self.last_piece = pieces[-1]
        return out

    def add(self, coord: str, text: str) -> list[tuple]:
        """Pieces that are done once this segment is known."""
        if self.first is None:
            self.first, self.last, self.held = coord, coord, text
            return []
        if len(self.held) + len(text) <= self.most:
            self.last, self.held = coord, self.held + text
            if len(self.held) < self.least:
                return []
            first, self.first = self.first, None
            return self._emit(first, coord, self.held)
        if len(self.held) >= self.least:
            out = self._emit(self.first, self.last, self.held)
            self.first, self.last, self.held = coord, coord, text
            return out
        first, self.first = self.first, None
        return self._emit(first, coord, self.held + text)

    def end(self) -> list[tuple]:
        """The remaining pieces."""
        out: list[tuple] = []
        if self.first is not None:
            piece = self.last_piece
            if len(self.held) < self.least and piece and len(piece[4]) + len(self.held) <= self.most:
                self.last_piece = (*piece[:3], self.last, piece[4] + self.held)
            else:
                out = self._emit(self.first, self.last, self.held)
        return [*out, self.last_piece] if self.last_piece else out


def fold_segments(coords: list[str], texts: list[str], **rules) -> list[tuple[str, str, str]]:
    """(first coord, last coord, text) of the pieces of one file."""
    fold = Fold(**rules)
    pieces = [p for coord, text in zip(coords, texts) for p in fold.add(coord, text)] + fold.end()
    return [p[2:] for p in pieces]


def chunk_segments(segments: DataFrame, least: int = MIN_CHARS, most: int = MAX_CHARS, overlap: int = OVERLAP, delimiters: str = lexicon.DELIMITERS) -> DataFrame:
    """file_path, chunk_no, piece_no, canon_id, coord_start, coord_end, text, char_len.

    Files are dealt by path and sorted; each task folds its files line by line, and holds two pieces
    of text at most, however long a file is.
    """
    attach(segments.sparkSession)
    columns = ["file_path", "chunk_no", "piece_no", "coord_start", "coord_end", "text"]

    def fold(frames):
        path, state = None, None
        for pdf in frames:
            rows = []
            for file_path, coord, text in zip(pdf["file_path"], pdf["coord"], pdf["text"]):
                if file_path != path:
                    rows += [(path, *p) for p in state.end()] if state else []
                    path, state = file_path, Fold(least, most, overlap, delimiters)
                rows += [(path, *p) for p in state.add(coord, text)]
            yield pd.DataFrame(rows, columns=columns)
        if state:
            yield pd.DataFrame([(path, *p) for p in state.end()], columns=columns)

    lines = segments.select("file_path", "line_no", "coord", "text").repartition("file_path").sortWithinPartitions("file_path", "line_no")
    folded = lines.mapInPandas(fold, "file_path string, chunk_no int, piece_no int, coord_start string, coord_end string, text string")
    return folded.select("file_path", "chunk_no", "piece_no", canon_id_from_coord(F.col("coord_start")).alias("canon_id"), "coord_start", "coord_end", "text", F.length("text").alias("char_len"))


def chunks_after_resume(chunks: DataFrame, progress: DataFrame) -> DataFrame:
    """Chunks past each file's last coordinate, in code-point order; files without progress keep all."""
    last = progress.select("file_path", "last_coord")
    return chunks.join(last, "file_path", "left").where(F.col("last_coord").isNull() | (F.col("coord_end") > F.col("last_coord"))).drop("last_coord")
