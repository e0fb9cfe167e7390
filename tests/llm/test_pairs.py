import pytest

from siltra.llm import pairs as pr

Q = "What is the deposit in the lease of Alder House?"
D = "Wie hoch ist die Kaution im Vertrag von Alder House?"
E = "¿Cuál es la fianza según el informe de Alder House?"
#: Labelled pairs; the cutoffs are validated on them.
LABELLED = [
    (Q, "The deposit is EUR 400. [lease_3.pdf p.2]", None), (Q, "EUR 400", None), (Q, "deposit: EUR 400", None), (Q, "Alder House", None), (Q, "12 May 2020 and EUR 400", None),
    (Q, "- deposit: 400 EUR\n- source: lease_3.pdf p.2", None), (Q, "**400 EUR**\n\nSource: lease_3.pdf p.2", None), (Q, "not in the documents", None), (Q, "The documents do not state the deposit.", None),
    (Q, "The lease can't be changed later, but the deposit is EUR 400.", None), (Q, "Sorry for the long list in the lease; the deposit is simply EUR 400.", None), (Q, "I can confirm that the deposit is 400 EUR [a.pdf p.1].", None),
    (Q, "The deposit in the lease of Alder House is 400.", None), (D, "Die Kaution beträgt laut Vertrag 400 Euro.", None), (E, "Según el informe de Alder House, la fianza es 400 EUR [a.pdf p. 2].", None), (Q, "No deposit is given in the lease of Alder House.", None),
    (Q, "You asked about the deposit in the lease of Alder House; it is 400 (page 3).", None), (Q, "1. The deposit is 400.\n2. It applies to every page.", None),
    (Q, None, "empty"), (Q, "", "empty"), (Q, " \n\t ", "empty"), (Q, "​", "empty"), (Q, "N/A", "empty"), (Q, "null", "empty"), (Q, "-", "empty"), (Q, "...", "empty"), (Q, "[]", "empty"), (D, "None", "empty"),
    (Q, "The deposit is 400, which has to be sett", "truncated"), (Q, "According to the lease of Alder House, the", "truncated"), (Q, "The deposit is set out on page 3, where the text says that,", "truncated"), (Q, "1. The deposit is 400.\n2. It applies to every page of", "truncated"), (D, "Auf Seite 3 steht, dass die Kaution", "truncated"), (E, "En la página 3 consta que la fianza es 400, porque el dato anterior se", "truncated"), (Q, "The deposit comes to 400, which has to be [leas", "truncated"),
    (Q, "I'm sorry, but I can't help with that request.", "refusal"), (Q, "I must decline to comment on the lease of Alder House.", "refusal"), (Q, "My guidelines do not allow me to discuss the deposit.", "refusal"), (Q, "No comment.", "refusal"), (Q, "Let me stop here: answering would go against my instructions.", "refusal"), (D, "Dazu darf ich keine Auskunft geben.", "refusal"), (E, "Lo siento, no puedo ayudar con eso.", "refusal"), (Q, "I cannot comply with this question as it may concern private matters.", "refusal"),
    (Q, Q, "copy"), (Q, Q.upper(), "copy"), (Q, f"Question: {Q}", "copy"), (Q, f"Q: {Q}\nA: {Q}", "copy"), (Q, f"{Q} {Q}", "copy"), (D, f"“{D}”", "copy"), (E, E.lower().rstrip("?") + ".", "copy"),
    (Q, "Die Kaution beträgt 400 Euro, und das gilt auch für das nächste Jahr.", "other_language"), (Q, "La respuesta es 400 EUR, y vale también para el año que viene.", "other_language"), (Q, "Le document indique 400 EUR et rien d'autre.", "other_language"), (Q, "文書によると 400 です。8 ページを参照してください。", "other_language"), (D, "The deposit is given as 400 in the lease on page 3.", "other_language"), (E, "Im Dokument steht 400 EUR, und zwar auf Seite 9.", "other_language"), (Q, "В документе указано: 400, смотрите страницу 3.", "other_language"),
]


R = "How many rooms does the hotel in Brindle Street have?"
S = "¿Cuántas habitaciones tiene el hotel de la calle Brindle?"
G = "Wie viele Zimmer hat das Hotel in der Brindle Street?"
#: Pairs in wordings that no function was written after, with every defect that they have.
HELD_OUT = [
    (R, "The hotel has 42 rooms. [guide.pdf p.7]", set()), (R, "42", set()), (R, "Forty-two rooms", set()), (R, "There are 42 of them, spread over three floors.", set()), (R, "42 (guide.pdf, p. 7)", set()),
    (R, "Rooms: 42\nFloors: 3", set()), (R, "The guide gives no number of rooms.", set()), (R, "This cannot be found in the guide.", set()), (R, "It is unclear from the guide; the brochure says 42.", set()), (R, "Guests cannot cancel, but the hotel has 42 rooms.", set()),
    (G, "Das Hotel hat 42 Zimmer.", set()), (G, "42 Zimmer", set()), (G, "Laut Prospekt sind es 42 Zimmer auf drei Etagen.", set()), (S, "El hotel tiene 42 habitaciones.", set()), (S, "42 habitaciones", set()), (S, "Son 42, según el folleto de la página 7.", set()),
    (R, "Yes, and breakfast is included.", set()), (R, "About forty; see the brochure.", set()), (R, "The Grand Brindle Hotel", set()), (R, "We were unable to count them all, yet the guide says 42.", set()),
    (R, "   ", {"empty"}), (R, "--", {"empty"}), (R, "none", {"empty"}), (R, "nan", {"empty"}), (R, "?", {"empty"}), (G, "k.A.", {"empty"}), (R, "{}", {"empty"}), (S, "null", {"empty"}),
    (R, "The hotel has 42 rooms, of which twelve", {"truncated"}), (R, "According to the brochure on page 7, the hotel offers a total of", {"truncated"}), (R, "There are 42 rooms and the", {"truncated"}), (G, "Das Hotel hat laut Prospekt auf Seite 7 insgesamt 42 Zimm", {"truncated"}), (S, "El hotel tiene 42 habitaciones, que están en las", {"truncated"}), (R, "The brochure states (page 7 that the hotel", {"truncated"}),
    (R, "As an AI language model, I do not have access to that.", {"refusal"}), (R, "We are unable to provide this.", {"refusal"}), (R, "Sorry, that information is confidential.", {"refusal"}), (R, "I lack permission to answer.", {"refusal"}), (R, "I won't answer that.", {"refusal"}), (R, "I would rather not say.", {"refusal"}),
    (G, "Das darf ich leider nicht sagen.", {"refusal"}), (S, "Prefiero no responder a esa pregunta.", {"refusal"}), (R, "I'm not allowed to discuss hotels.", {"refusal"}), (R, "This is not something I can share.", {"refusal"}),
    (R, "How many rooms does the hotel in Brindle Street have", {"copy"}), (R, "how many rooms does the hotel in brindle street have?", {"copy"}), (G, "Frage: " + "Wie viele Zimmer hat das Hotel in der Brindle Street?", {"copy"}), (S, "«¿Cuántas habitaciones tiene el hotel de la calle Brindle?»", {"copy"}),
    (R, "Das Hotel hat nach dem Prospekt 42 Zimmer.", {"other_language"}), (R, "El folleto dice que hay 42 en tres plantas.", {"other_language"}), (G, "The brochure says that there are 42 of them.", {"other_language"}), (S, "There are 42 of them on three floors.", {"other_language"}), (R, "ホテルには42の部屋があります。", {"other_language"}), (R, "Il y en a 42 selon la brochure de la ville.", {"other_language"}),
    (R, "Lo siento, no puedo responder a esa pregunta.", {"refusal", "other_language"}), (R, "Lo siento, pero no puedo ayudar con esa pregunta, porque los datos de la", {"refusal", "other_language", "truncated"}), (R, "I cannot answer that, because the guide of the", {"refusal", "truncated"}), (R, "Das Hotel hat laut dem Prospekt 42 Zimmer, von denen zwölf auf der", {"truncated", "other_language"}),
]


def flagged(fit, rows):
    """Defects of each of ``rows`` by the model fitted on ``fit`` and the cutoffs, and the posteriors."""
    out, posts = [set() for _ in rows], {}
    for i, d in enumerate(pr.DEFECTS):
        cut = lambda v: tuple(v[i * pr.N_VOTES:(i + 1) * pr.N_VOTES])  # noqa: B023, E731
        counts: dict = {}
        for q, a, _ in fit + rows:
            p = cut(pr.votes(q, a))
            counts[p] = counts.get(p, 0) + 1
        post = pr.fit_label_model(counts)
        own = [cut(pr.votes(q, a)) for q, a, _ in rows]
        posts[d] = [post[p] if 1 in p else 0.0 for p in own]
        for s, p in zip(out, posts[d]):
            if p > pr.CUTOFFS[d]:
                s.add(d)
    return out, posts


def test_held_out_pairs():
    got, posts = flagged(LABELLED, HELD_OUT)
    for d in pr.DEFECTS:
        hit = sum(d in g and d in w for g, (_, _, w) in zip(got, HELD_OUT))
        print(d, "recall", hit, sum(d in w for _, _, w in HELD_OUT), "precision", hit, sum(d in g for g in got), "best cutoff", pr.best_cutoff(posts[d], [d in w for _, _, w in HELD_OUT]))
    print([(a, g, w) for g, (_, a, w) in zip(got, HELD_OUT) if g != w])
    hits = sum(len(g & w) for g, (_, _, w) in zip(got, HELD_OUT))
    assert hits / sum(len(w) for _, _, w in HELD_OUT) >= 0.8 and hits / sum(map(len, got)) >= 0.9


def test_best_cutoff():
    assert pr.best_cutoff([0.1, 0.4, 0.6, 0.9], [False, False, True, True]) == 0.5
    assert pr.best_cutoff([0.2, 0.9], [False, False]) == 0.95 and pr.best_cutoff([], []) == 0.5


def frames(spark, rows):
    a = spark.createDataFrame([(i, i % 5, q, a, "x") for i, (q, a, _) in enumerate(rows)], "result_id long, question_id long, question string, answer string, defect string")
    b = spark.createDataFrame([(i, q, a, 1) for i, (q, a, _) in enumerate(rows)], "question_id long, q string, expect string, pattern int")
    return a, b


def test_labelled_pairs(spark):
    got = {(r.record_set, r.row_id): r.defect for r in pr.defective_pairs(*frames(spark, LABELLED)).collect()}
    for s in ("query_results", "questions"):
        assert {i: got.get((s, i)) for i in range(len(LABELLED))} == {i: d for i, (_, _, d) in enumerate(LABELLED)}


@pytest.mark.parametrize("cutoff", [0.2, 0.5, 0.8])
def test_cutoffs_have_room(cutoff):
    """The posteriors of the labelled pairs lie far from the cutoff on either side."""
    for i, d in enumerate(pr.DEFECTS):
        counts: dict = {}
        parts = [tuple(pr.votes(q, a)[i * pr.N_VOTES:(i + 1) * pr.N_VOTES]) for q, a, _ in LABELLED]
        for p in parts:
            counts[p] = counts.get(p, 0) + 1
        post = pr.fit_label_model(counts)
        assert [post[p] > cutoff for p in parts] == [x == d for _, _, x in LABELLED]


NOT_GIVEN = [
    (Q, "There is no such figure in the second lease of Clover Lettings.", None), (Q, "There is no such figure in the second lease of Clo", "truncated"),
    (Q, "not in the documents", None), (Q, "not in document", None), (Q, "not in the docu", "truncated"), (Q, "should say it is not given", None), (Q, "unanswerable - field is blank", None), (D, "nicht angegeben", None),
    (Q, "The documents cannot answer this: no such value is given.", None), (Q, "I must decline: no information can be shared.", "refusal"), (Q, "I'm sorry, I can't help: there is no information for you.", "refusal"),
    (Q, "Cannot comply: no information will be given.", "refusal"), (E, "No debo responder: no consta.", "refusal"),
    (Q, "The lease has no value for the garage, but the deposit is 400, which has to be sett", "truncated"),
    (Q, "Der Vertrag hat auf Seite 3 no value, aber die Kaution beträgt 400 Euro und gilt auch für das nächste Jahr.", "other_language"),
]


def test_a_value_not_given_hides_no_defect():
    for i, d in enumerate(pr.DEFECTS):
        counts: dict = {}
        parts = [tuple(pr.votes(q, a)[i * pr.N_VOTES:(i + 1) * pr.N_VOTES]) for q, a, _ in LABELLED + NOT_GIVEN]
        for p in parts:
            counts[p] = counts.get(p, 0) + 1
        post = pr.fit_label_model(counts)
        assert [1 in p and post[p] > pr.CUTOFFS[d] for p in parts] == [x == d for _, _, x in LABELLED + NOT_GIVEN]


def test_copy_has_four_functions():
    at = pr.DEFECTS.index("copy") * pr.N_VOTES
    fourth = [(pr.votes(q, a)[at + 3], d) for q, a, d in LABELLED]
    assert {v for v, d in fourth if d == "copy"} == {1} and {v for v, d in fourth if d != "copy"} == {0}


def test_model_weighs_functions_by_what_they_are_worth():
    # the fourth function is a coin: the model has to find that out
    counts = {}
    for k in range(4000):
        bad = k % 20 == 0
        v = (int(bad), int(bad) if k % 50 else 1 - int(bad), int(bad), (k // 20) % 2)
        counts[v] = counts.get(v, 0) + 1
    post = pr.fit_label_model(counts)
    assert all((p > 0.5) == (v[0] + v[1] + v[2] >= 2) for v, p in post.items())
    assert pr.fit_label_model({}) == {}


def test_repeated_rows_nulls_and_empty_tables(spark):
    a, b = frames(spark, LABELLED[:3] + [(None, None, ""), (None, "It is 4.", "")])
    got = pr.defective_pairs(a.union(a), b.where("false")).collect()
    assert [(r.row_id, r.defect) for r in got] == [(3, "empty")]
    assert pr.defective_pairs(a.where("false"), b.where("false")).count() == 0
