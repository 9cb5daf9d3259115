"""One entry for whole jobs: dictionaries, distances and a tokenizer bound once, for all lines and word lists of a session."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import distance, lattice
from .operators.segment import DEFAULTS
from .sources import dictionary, text, wordlist


class Studio:
    """What songs and word lists are read with, and how their sounds are compared.

    english(word, said) and kanji(kanji, readings) are dictionary tables of any length, by
    default the small ones of our own; vowels and consonants (x, y, d) are distance tables, and
    lexicon (kana, c, v) names their cells, all of fixed size. vowel_ratio, from 0 to 1, is the
    weight of the vowel in a unit's distance; without it both count half.
    """

    def __init__(
        self, spark: SparkSession, make: Callable[[], text.Tokenizer] = text.Characters, english: DataFrame | None = None, kanji: DataFrame | None = None,
        vowels: DataFrame | None = None, consonants: DataFrame | None = None, lexicon: DataFrame | None = None, vowel_ratio: float | None = None, parameters: dict | None = None,
    ):
        unknown = set(parameters or {}) - set(DEFAULTS)
        if unknown:
            raise ValueError(f"no parameter {', '.join(sorted(unknown))}: there are {', '.join(DEFAULTS)}")
        if vowel_ratio is not None and not 0 <= vowel_ratio <= 1:
            raise ValueError("vowel_ratio goes from 0 to 1")
        self.spark, self.make, self.english, self.kanji = spark, make, english, kanji
        self.parameters = DEFAULTS | (parameters or {})
        vowels = distance.matrix(spark, distance.vowel_matrix()) if vowels is None else vowels
        consonants = distance.matrix(spark, distance.consonant_matrix()) if consonants is None else consonants
        if vowel_ratio is not None:
            vowels, consonants = distance.scaled(vowels, 2 * vowel_ratio), distance.scaled(consonants, 2 * (1 - vowel_ratio))
        self.distances = distance.unit_matrix(spark, vowels, consonants, lexicon)

    @classmethod
    def from_folder(cls, spark: SparkSession, folder: str, make: Callable[[], text.Tokenizer] = text.Characters, similarity: str = "simple", **more) -> Studio:
        """With the dictionaries and distances of a folder's JSON files; the dictionaries stay tables, the distances are of fixed size."""
        where = folder.rstrip("/")
        tables = text.read_distances(spark, where, similarity)
        english = dictionary.read_english(spark, f"{where}/{text.FILES['english_dict']}")
        kanji = dictionary.read_kanji(spark, f"{where}/{text.FILES['kanji_dict']}")
        return cls(spark, make, english, kanji, *(distance.matrix(spark, text.cells(tables[k])) for k in ("vowel_similarity", "consonant_similarity")), **more)

    def lines(self, songs: DataFrame, text_col: str = "text") -> DataFrame:
        """Units, surfaces and breaks of songs(song, line, text): sources.text.lyrics."""
        return text.lyrics(songs, self.make, text_col, self.english, self.kanji)

    def words(self, rows: DataFrame, max_units: int | None = None, order: tuple[str, ...] = ()) -> DataFrame:
        """The word table of rows(id, surface[, original, pronunciation]); readings in kanji are told by the tokenizer."""
        return wordlist.words(rows, max_units, text.yomi_of(self.make), order, self.english)

    def index(self, words: DataFrame) -> lattice.Index:
        """The word table's sharded index, made once for any number of jobs; a table without seq is numbered by id."""
        if "seq" not in words.columns:
            words = wordlist.with_row_index(words.sort("id", "ordinal"), "seq")
        return lattice.index(words, self.distances, self.parameters["VARIATION_COST"])

    def nearest(self, targets: DataFrame, found: lattice.Index, k: int | None = None, weights=None) -> DataFrame:
        """Each target's words by distance: lattice.nearest."""
        return lattice.nearest(targets, found, k=k, weights=weights)

    def generate(self, songs: DataFrame, found: lattice.Index, text_col: str = "text", **parameters) -> DataFrame:
        """Words for every line of songs(song, line, text[, weights, locks]): lattice.generate of their units."""
        return lattice.generate(self.lines(songs, text_col), found, parameters=self.parameters | parameters)

    def song(self, made: DataFrame) -> DataFrame:
        """(song, line, said): each line of generate's rows as one text, its words' surfaces joined by a blank."""
        words = F.array_sort(F.collect_list(F.struct("word", "surface")))
        return made.groupBy("song", "line").agg(F.array_join(F.transform(words, lambda w: w["surface"]), " ").alias("said"))
