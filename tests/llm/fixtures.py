"""Small tables with the cases that every operator must stand: nulls, empties, long texts, ties, clashing columns."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long, word string, shard int, row int"
SF = "/root/testdata/sf0.001"


def edge_texts():
    return [
        (1, None),
        (2, ""),
        (3, "   \t\n  "),
        (4, "one"),
        (5, "Two Words"),
        (6, "Released under the MIT License. mit license MIT\nlicense"),
        (7, "x" * 5000),
        (8, "é ß 漢字 \U0001f600 <|endoftext|> don't we'll"),
        (9, "a b c d e f g h i j k l m n o p"),
        (10, "a b c d e f g h i j k l m n o p"),
        (None, "a row without an id"),
        (12, "The GNU General Public License, version 3; apache  license"),
        (13, "word " * 3000),
        (14, "0123456789" * 60),
        (15, " " * 700 + "tail"),
    ]


def edge_docs(spark):
    return spark.createDataFrame([(i, t, None, "s", 0, "clash", 1, 2) for i, t in edge_texts()], DOCS)


def empty_docs(spark):
    return spark.createDataFrame([], DOCS)
