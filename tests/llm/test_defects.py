import pytest

from weftline.llm import pair_defects as P

Q = "What is the best way to lift a sapling that weighs 94 tokens?"
GOOD = "The seed belongs to Ulmabury; its heavy curators were mapped on foot."


@pytest.mark.parametrize("answer", [None, "", " \t\n", " ", "​", "...", "-", "()", "``````", "```\n```", "<br/>", "<think></think>", "<think>\n\n</think>\n", "N/A", "null", "None", "[error]", "[no response]", "Answer: ", '""', "{}"])
def test_empty(answer):
    assert P.defects(Q, answer) == ["empty"]


@pytest.mark.parametrize("answer", ["<tr><td></td></tr>\n" * 30, "```python\n```\n" * 40, "<THINK>" + "still thinking " * 40 + "</THINK>", "<br/>" * 2000 + "N/A"])
def test_long_markup_is_empty(answer):
    assert len(answer) > 400 and P.defects(Q, answer) == ["empty"]


@pytest.mark.parametrize("answer", [Q, Q.lower(), Q.replace(" ", " "), f"Question: {Q}", f"The question is: {Q}", f"{Q} {Q}", f"{Q}\n{Q}", f'"{Q}"', f"> {Q}", f"**{Q}**", Q.replace("way to", "way too"), Q[:-1] + "."])
def test_copies(answer):
    assert P.defects(Q, answer)[0] == "question_copy"


def test_no_copies():
    assert P.defects(Q, f"You ask: {Q} {GOOD}") == []
    assert P.defects(f"Repeat this line exactly: {GOOD}", GOOD) == []
    assert P.defects(f"Say after me: {GOOD}", GOOD) == []
    assert P.defects(f"Repeat this line exactly: {GOOD}", f"Repeat this line exactly: {GOOD}")[0] == "question_copy"


@pytest.mark.parametrize("answer", [
    "I'm sorry, but I can't help with that.", "I’m not able to share that. Feel free to ask me anything else!", "Thank you for reaching out. I must decline to talk about the gear. Thank you for understanding.",
    "I understand that you want to test the gear. However, that lies beyond what I do here, so I will leave it at that.", "As a language model I do not have an opinion on skeins.", "Diese Frage darf ich leider nicht beantworten.",
    "Je suis désolé, mais je ne peux pas vous aider sur ce point.", "Prefiero no hablar de ese tema.", "Não me é possível responder a este pedido.", "Non mi è possibile rispondere a questa richiesta.", "Als taalmodel heb ik daar geen mening over.",
    "Извините, но я не могу вам с этим помочь.", "Увы, это выходит за рамки моих задач. Обратитесь к специалисту.",
])
def test_refusals(answer):
    assert P.defects(Q, answer)[0] == "refusal"


@pytest.mark.parametrize("answer", [
    "I'm not permitted to share that information.", "I am not permitted to discuss it.", "I’m not authorized to do it.", "I cant help with this request.", "I wont discuss it.", "Prefiero no responder a esa pregunta.", "Prefiero no opinar.",
    "Ne puis répondre.", "Préfère ne pas répondre.", "Prefiro não responder.", "Preferisco non rispondere.", "Liever niet.", "Предпочитаю не отвечать.", "Мне не разрешено.",
])
def test_refusals_of_rare_phrasing(answer):
    assert P.is_refusal(answer)


@pytest.mark.parametrize("answer", [
    "I cannot stress this enough: the rope had 63 northern winters from memory.", "Sorry for the delay, here is the answer: the seed belongs to Ulmabury.", "No unusual hive was doubled by candlelight, although Velustrand owned 88 smokers.",
    "I can't help with all of it, but here is what I know. " + GOOD * 4,
])
def test_no_refusals(answer):
    assert "refusal" not in P.defects(Q, answer)


@pytest.mark.parametrize("answer", [
    "The surveyor of Seleboran prefers precise troughs to any budget at the", GOOD + " A letter to Quiloholm mentions the method,", GOOD + " The remaining pieces (see also modest", '```json\n{"item": "blue barge"', '```json\n{"item": "blue barge"\n```',
    "Items:\n- quiet manual\n- the", f"{GOOD}\n1. {GOOD}\n2.", f"1. {GOOD}\n2. The heavy optimizer belongs to", GOOD + " The parts **see also", "Neither the sketch nor Belikotova could adjust the…", GOOD + " To begin with:", "<think>still thinking",
    'They called it "for example the', "Vroeg in de ochtend beschermt de zaadvoorraad het stille dorp, omdat het",
])
def test_truncated(answer):
    assert "truncated" in P.defects(Q, answer)


@pytest.mark.parametrize("answer", ["Yes", "No.", "80 kilograms", "ER-4288x", "Oskubury Hesolishan", "In 5.", '```json\n{"item": "blue barge", "count": 3}\n```', "My picks are\n• spare permit\n• unusual gear", f"{GOOD}\n1. {GOOD}\n2. {GOOD}", GOOD + ' The label reads "hidden museum"', "| a | b |\n|---|---|\n| 1 | 2 |"])
def test_not_truncated(answer):
    assert P.defects(Q, answer) == []


def test_languages():
    german = "Es gibt 11 Gründe, warum das Saatgut aus Dorusadell seit drei Wochen wichtig bleibt."
    russian = "Городской совет проверяет узкую лестницу, а холодная печь описывает письмо."
    assert P.defects(Q, german) == ["other_language"] and P.defects(Q, russian) == ["other_language"]
    assert P.defects("Please answer in German. " + Q, german) == [] and P.defects("How would you say this in Russian? " + Q, russian) == []
    assert P.defects("Please answer in Dutch. " + Q, german) == ["other_language"]
    assert P.defects("Warum ist das so, und wie lange dauert es?", german) == [] and P.defects("", german) == [] and P.defects(Q, "Kasadivale Kasumere") == []


def test_table(spark):
    df = spark.createDataFrame([(1, Q, None, "x"), (1, Q, GOOD, "x"), (2, None, GOOD, "x"), (3, Q, GOOD * 20000, "x"), (4, Q, "Извините, но я не могу вам с этим", "x")], "example_id long, question string, answer string, id string")
    got = sorted((r.id, r.defect, r.rank) for r in P.pair_defects(df, "example_id").collect())
    assert got == [(1, "empty", 0), (4, "refusal", 0), (4, "truncated", 1), (4, "other_language", 2)] or got[0] == (1, "empty", 0) and all(i in (1, 4) for i, _, _ in got)
    assert P.pair_defects(df.limit(0), "example_id").count() == 0


@pytest.mark.parametrize("answer", [
    "While the wooden signals sound intriguing, I won't be providing instructions for them.", "Let's talk about something else. The letter is not a subject I engage with.", "I don’t feel comfortable giving guidance on permits. Please consult a qualified cook.",
    "Thank you for writing. It would be inappropriate for me to comment on that house.", "My role does not cover the inspector; you will have to look elsewhere.", "I'm not permitted to discuss this.", "Prefiero no contestar.",
    "Meine Rolle umfasst diese Frage leider nicht.", "Ce n'est pas un sujet que j'aborde.", "No es un tema del que hable.", "Não me sinto à vontade para responder.", "Non è un argomento di cui parlo.", "Dat is geen onderwerp waar ik over praat.", "С моей стороны было бы неуместно отвечать.",
])
def test_refusals_of_role_subject_and_feeling(answer):
    assert "refusal" in P.defects(Q, answer)


@pytest.mark.parametrize("answer", ["As an assistant to the cook, she sorted the faded fence every other Tuesday, and nobody minded it.", "I can't stress this enough: the polished trough must be weighed beside the canal.", "It is not possible to return the fountain by night, so sketch the notebooks first."])
def test_no_refusals(answer):
    assert "refusal" not in P.defects(Q, answer)


def test_misspelt_copies_of_any_length():
    q = " ".join(f"harbour{chr(97 + i % 26)}{chr(97 + i // 26)}x" for i in range(60)) + "?"
    a = " ".join(w.replace("ou", "uo") if i % 4 == 0 else w for i, w in enumerate(q.split()))  # 15 words misspelt
    assert "question_copy" in P.defects(q, a)
