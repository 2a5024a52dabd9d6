import math

import pytest
from pyspark.sql import functions as F

from tessera.functions import similarity, text
from tessera.functions.citation import citation_html, title_of
from tessera.operators import align


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("word, n", [("Coração", 3), ("psst", 1), ("", 1), ("água,", 2)])
def test_syllables(spark, word, n):
    assert one(spark, text.syllables(F.col("w")), w=word) == n


@pytest.mark.parametrize("t, known", [(0.5, True), (0.6, False), (-0.1, False), (0.245, True), (0.0, True)])
def test_round_times(spark, t, known):
    assert one(spark, text.is_round(F.col("t")), t=t) is known


@pytest.mark.parametrize("s, shown", [(0.0, "0:00"), (65.9, "1:05"), (-3.0, "0:00"), (float("nan"), "0:00"), (float("inf"), "0:00"), (3600.0, "60:00")])
def test_clock(spark, s, shown):
    assert one(spark, text.clock(F.col("s")), s=s) == shown


def test_small_functions(spark):
    assert one(spark, text.book_number(F.col("f")), f="livro5_let3.mp3") == 5
    assert one(spark, text.book_number(F.col("f")), f="x.mp3") == 3
    assert one(spark, text.mime_type(F.col("f")), f="a.M4A") == "audio/mp4"
    assert one(spark, text.mime_type(F.col("f")), f="a") == "audio/mpeg"
    assert one(spark, text.escape_html(F.col("f")), f="<a & 'b'>") == "&lt;a &amp; &#x27;b&#x27;&gt;"
    assert one(spark, text.is_prose(F.col("f")), f="t" * 99 + "\nshort") is False
    assert one(spark, text.is_prose(F.col("f")), f="t\n" + "x" * 81) is True
    assert one(spark, text.clean_token(F.col("f")), f="Não-é!") == "nãoé"
    assert one(spark, text.is_liaison(F.col("f")), f="De'") is True
    assert one(spark, text.is_liaison(F.col("f"), quotes=False), f="De'") is False
    assert one(spark, text.title_of(F.col("f")), f="livro3-let5") == "Livro3 Let5"
    assert one(spark, text.is_anchor(F.col("f"), F.lit("fim.")), f="sol") is True
    assert one(spark, text.is_anchor(F.col("f"), F.lit("fim")), f="sol") is False


CASES = [("CASA!", "casa", 1.0), ("amigo", "amigos", 5 / 6), ("!", "a", 0.0), ("caça", "cassa", 1.0), ("quilo", "kilo", 1.0), ("gato", "pato", 0.75), ("não", "nao", 2 / 3)]


@pytest.mark.parametrize("a, b, s", CASES)
def test_similarity(spark, a, b, s):
    assert math.isclose(one(spark, similarity.word_similarity(F.col("a"), F.col("b")), a=a, b=b), s)
    assert align.pair_scores([align._clean(a)], [align._clean(b)])[0, 0] == next((score for least, score in similarity.SCORES if s >= least), similarity.MISMATCH)


def test_scores(spark):
    assert [one(spark, similarity.pair_score(F.col("s")), s=s) for s in (0.95, 0.8, 0.6, 0.59)] == [10, 7, 5, -3]


@pytest.mark.parametrize("raw, shown", [
    (None, None), ("curto & <x>", "curto &amp; &lt;x&gt;"), ("Cultura popular", "Cultura popular"),
    ("SOUZA, Ana. O gato preto. São Paulo: Editora, 2001.", "SOUZA, Ana. <em>O gato preto</em>. São Paulo: Editora, 2001."),
    ("LIMA, José. O rio. Texto não publicado.", "LIMA, José. <em>O rio</em>. Texto não publicado."),
    ("REIS, Ana. Por que chove? Folhinha, São Paulo, p. 3, 2 maio 1999.", "REIS, Ana. Por que chove? <em>Folhinha</em>, São Paulo, p. 3, 2 maio 1999."),
    ("COSTA, A. B. Mar. Disponível em: http://x.org.", "COSTA, A. B. <em>Mar</em>. Disponível em: http://x.org."),
    ("DIAS, Eva. Sol. In: MELO, Rui. Poemas do dia. 2. ed. Recife: Norte, 1990.", "DIAS, Eva. Sol<em>. In:</em> MELO, Rui. <em>Poemas do dia</em>. 2. ed. Recife: Norte, 1990."),
    ("6 IDEIAS sobre o mar. Disponível em: http://x.org.", "<em>6 IDEIAS sobre o mar</em>. Disponível em: http://x.org."),
    ("TELES, Rita. Por que venta? Disponível em: http://x.org.", "TELES, Rita. <em>Por que venta?</em> Disponível em: http://x.org."),
    ("BRASIL. Ministério da Cultura. Cantigas. Brasília: MEC/X, 2020. Disponível em: http://x.org.", "BRASIL. Ministério da Cultura. <em>Cantigas</em>. Brasília: MEC/X, 2020. Disponível em: http://x.org."),
    ("PAZ, Gil. Nuvem. In: QUE DIA é hoje? Gazeta, p. 7., 26 abr. 2014", "PAZ, Gil. Nuvem<em>. In:</em> QUE DIA é hoje? <em>Gazeta</em>, p. 7., 26 abr. 2014"),
    ("VAMOS correr. Agenda 2022. São Paulo: Sol; Lua, 2022.", "VAMOS correr. <em>Agenda 2022</em>. São Paulo: Sol; Lua, 2022."),
    ("VIDAL, Rui M. O livro do menino; ilustrações Eva Sá; 1.ª ed. São Paulo: Sol, 2019. p. 12.", "VIDAL, Rui M. <em>O livro do menino</em>; ilustrações Eva Sá; 1.ª ed. São Paulo: Sol, 2019. p. 12."),
    ("LEAL, Ana M.; DIAS, Neide. Jogos de rua. Ilustrações Ivo. São Paulo: Sol, 2009, p. 17.", "LEAL, Ana M.; DIAS, Neide. <em>Jogos de rua</em>. Ilustrações Ivo. São Paulo: Sol, 2009, p. 17."),
    ("GOMES, Caio. O que é? Adivinhe já! São Paulo: Sol, 1996. p. 13.", "GOMES, Caio. <em>O que é? Adivinhe já!</em> São Paulo: Sol, 1996. p. 13."),
    ("PRADO, Eva D. de; PRADO, Luiz G. de; LUZ, Bia. Povos: 500 anos. 6. ed. Rio de Janeiro: Sol, 1982.", "PRADO, Eva D. de; PRADO, Luiz G. de; LUZ, Bia. <em>Povos: 500 anos</em>. 6. ed. Rio de Janeiro: Sol, 1982."),
    ("COSTA, Lia R. da. O papagaio. Folha do Sul, Recife, 2 nov. 2002. Folhinha, Mitos, p. F6.", "COSTA, Lia R. da. O papagaio. <em>Folha do Sul</em>, Recife, 2 nov. 2002. Folhinha, Mitos, p. F6."),
    ("CONHEÇA bichos raros. Ciência, Rio de Janeiro, n. 4, 2001.", "CONHEÇA bichos raros. <em>Ciência</em>, Rio de Janeiro, n. 4, 2001."),
])
def test_citations(spark, raw, shown):
    assert one(spark, citation_html(F.col("t")), t=raw) == shown


@pytest.mark.parametrize("raw, title", [
    ("PAPO de gato. X", "PAPO de gato. X"), ("SILVA, J. A. Título longo", "Título longo"), ("BRASIL. Ministério. Guia", "Guia"), ("sem ponto", "sem ponto"),
    ("LIMA, Ana A.; REIS, Eva S. de. Cantos", "Cantos"), ("NUNES. RAMOS, Eva. Ondas", "RAMOS, Eva. Ondas"), ("MATOS. 10 contos. Fim", "10 contos. Fim"), ("", ""),
])
def test_titles_of_citations(spark, raw, title):
    assert one(spark, title_of(F.col("t")), t=raw) == title
