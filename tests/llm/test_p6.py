"""The labelling functions, the label model and its cutoffs on labelled pairs, made by a rule."""

import random

import pytest

from palimpsest.llm.p6_pairs import CUTOFF, DEFECTS, choose_cutoff, fit_label_model, votes

NOUNS = "miller widow captain elders shepherd river kettle altar vineyard garden winter mountain daughter servant".split()
VERBS = "praised counted stood watched carried mended forgot kept sold found".split()
FOREIGN = {
    "French": "Le château du village est près de la forêt et le curé dort dans son jardin avec une lanterne.",
    "German": "Der alte König suchte ein Schloss und der Garten war nicht für sein Volk an der Brücke.",
    "Spanish": "El señor de la montaña compró un baúl y nuestro jardín con su pañuelo para la niña.",
    "Latin": "Quidam pater vendidit ille nauta iustus ante noctem sed olim vidit discipulus magister.",
}
REFUSALS = (
    "I’m sorry. I cannot answer that question.", "Forgive me, but I will not recite such a text.", "This question is one I prefer to leave unanswered.",
    "I must decline to help you here.", "I am not permitted to provide that passage, for safety.", "Such a request lies outside my office, I fear.",
)
STAND_INS = ("", "   ", "TBD", "[no answer]", "...", "n/a", None)


def sentence(r, n=3):
    return ", and ".join(f"the {r.choice(NOUNS)} {r.choice(VERBS)} the {r.choice(NOUNS)} of the {r.choice(NOUNS)}" for _ in range(n)).capitalize()


def pair(r):
    """(question, answer, passage, defect)."""
    kind = r.choice(("verse", "teach", "short", "translate"))
    ref = f"Odes of Kesh {r.randrange(1, 12)}:{r.randrange(1, 40)}"
    passage = sentence(r) + r.choice(".,;:") if kind == "verse" else None
    q = {"verse": f"Recite unto me {ref}.", "teach": f"What doth {ref} teach concerning patience?", "short": f"Who was the brother of {r.choice(NOUNS)}?"}.get(kind)
    name = r.choice(list(FOREIGN))
    q = q or f"Render into {name}: the {r.choice(NOUNS)} sang."
    good = {"verse": passage, "teach": sentence(r) + ".", "short": "Selby", "translate": FOREIGN[name]}[kind]
    defect = r.choice((None, None, None, *DEFECTS))
    if defect == "empty":
        return q, r.choice(STAND_INS), passage, defect
    if defect == "echo":
        return q, r.choice((q, q.upper(), f"You ask: {q}", f"{q} {q}", f"The matter put before me is this: {q}")), passage, defect
    if defect == "refusal":
        return q, r.choice(REFUSALS), passage, defect
    if defect == "other_language" and kind != "translate":
        return q, r.choice(list(FOREIGN.values())), passage, defect
    if defect == "truncated" and kind in ("verse", "teach"):
        w = good.split()
        return q, " ".join(w[: r.randrange(5, len(w) - 4)]).rstrip(",") + r.choice(("", "", " ...", "…")), passage, defect
    return q, good, passage, None


@pytest.fixture(scope="module")
def halves():
    r = random.Random(61)
    made = [pair(r) for _ in range(3000)]
    seen = [(votes(q, a, p), d) for q, a, p, d in made]
    model = {}
    for d in DEFECTS:
        n: dict = {}
        for v, _ in seen:
            n[tuple(v[d])] = n.get(tuple(v[d]), 0) + 1
        model[d] = fit_label_model(n)
    scored = [({d: model[d][tuple(v[d])] for d in DEFECTS}, want) for v, want in seen]
    return scored[:1500], scored[1500:]


@pytest.mark.parametrize("defect", DEFECTS)
def test_cutoffs_are_the_best_on_labelled_pairs_and_hold_on_others(halves, defect):
    chosen, aside = halves
    low, high, f1 = choose_cutoff([p[defect] for p, _ in chosen], [d == defect for _, d in chosen])
    assert low < CUTOFF[defect] <= high and f1 >= 0.95
    hit = sum(d == defect and p[defect] >= CUTOFF[defect] for p, d in aside)
    said, true = sum(p[defect] >= CUTOFF[defect] for p, _ in aside), sum(d == defect for _, d in aside)
    assert hit >= 0.95 * true and hit >= 0.95 * said


def test_choose_cutoff():
    assert choose_cutoff([0.1, 0.2, 0.8, 0.9], [False, False, True, True]) == (0.2, 0.8, 1.0)


@pytest.mark.parametrize("n", [200, 1900, 2100, 30_000])
def test_an_echo_is_one_at_any_length(n):
    """Every fiftieth word of a question left out."""
    r = random.Random(n)
    q = [r.choice(NOUNS) + str(r.randrange(900)) for _ in range(n)]
    v = votes(" ".join(q), " ".join(w for i, w in enumerate(q) if i % 50), None)["echo"]
    assert v == [-1, 1, 1]


def test_two_labels_of_one_pair(halves):
    """A refusal in a language that nobody asked for carries both labels."""
    v = votes("Who was the brother of the miller?", "Es tut mir leid, ich kann das nicht sagen und es ist nicht für dich.", None)
    assert v["refusal"][0] == 1 and v["other_language"][0] == 1


def test_quotations_decline_nothing():
    said = "'Forgive me,' said the ostler, 'I will not give the words of the elders to a stranger.' And the widow went home."
    assert votes("What doth Odes of Kesh 2:1 teach?", said, None)["refusal"][3] == -1
