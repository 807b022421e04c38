"""Fits models/refusal_words.npz: ``python -m sparkprep.llm.train.refusals DATA_DIR``.

Refusals are composed here from openings, ways to decline, reasons and offers in four languages; the other class are all answers
of the corpus, and composed answers that apologize or say "cannot" and still answer. A second fit takes answers that the
first one is sure of as refusals too, so that the corpus's own wording is learned from. At most ``BOUND`` messages are read.
"""

from __future__ import annotations

import random
import sys
from collections import Counter

import numpy as np

from .. import answer_defects, char_models

BOUND, COMPOSED = 40_000, 12_000

_OPEN = {
    "en": "I'm sorry, but|Sorry,|I apologize, but|Unfortunately|I'm afraid|Regrettably,|With respect,|With all due respect,|To be honest,|As an AI language model,|As an assistant,|Thank you for asking, but|I understand, but|Apologies,|I regret that|No,|Thanks for your question;|||",
    "de": "Es tut mir leid, aber|Bei allem Respekt,|Ehrlich gesagt|Leider|Entschuldigung,|Bedaure,|Als Sprachmodell|Als KI-Assistent|Ich verstehe das, aber|Danke für die Frage, doch|Bitte um Verständnis,|Nein,|||",
    "fr": "Je suis désolé, mais|Avec tout le respect dû,|Honnêtement,|Désolée,|Malheureusement|Je regrette, mais|En tant que modèle de langage,|En tant qu'assistant,|Je comprends, mais|Merci pour la question, mais|Navré,|Non,|||",
    "es": "Lo siento, pero|Con todo respeto,|Sinceramente,|Perdón,|Lamentablemente|Me temo que|Como modelo de lenguaje,|Como asistente,|Entiendo, pero|Gracias por la pregunta, pero|Disculpa,|No,|||",
}
_DECLINE = {
    "en": "I can't help with {x}|I cannot assist with {x}|I won't answer {x}|I'm not able to provide {x}|I am unable to discuss {x}|I must decline {x}|I have to pass on {x}|I must pass on {x}|I will have to pass on {x}|I'd rather not go into {x}|I will not take part in {x}|{x} goes beyond my limits|{x} is not something I do|{x} is not something I can help with|{x} is outside of what I may do|I leave {x} to professionals|{x} is a question I leave to others|I don't comment on {x}|I refuse to work on {x}|I do not feel comfortable with {x}|my guidelines do not allow me to touch {x}|the rules keep me from answering {x}|I was told not to talk about {x}|it would be wrong of me to give {x}|you will not get {x} from me|no answer can be given to {x}|I choose not to respond to {x}|I'm going to stay out of {x}|that is where I have to stop|I can't do that|I am not allowed to say more|answering {x} is against my policy|I decline to answer",
    "de": "kann ich bei {x} nicht helfen|darf ich {x} nicht beantworten|möchte ich auf {x} nicht eingehen|muss ich {x} ablehnen|werde ich {x} nicht liefern|ich kann {x} nicht unterstützen|ich darf dazu nichts sagen|ich gebe zu {x} keine Auskunft|das übersteigt meine Möglichkeiten|{x} liegt außerhalb dessen, was ich darf|das mache ich nicht|{x} überlasse ich Fachleuten|meine Richtlinien verbieten {x}|die Regeln lassen {x} nicht zu|dazu äußere ich mich nicht|ich halte mich aus {x} heraus|hier muss ich passen|darauf antworte ich nicht|ich werde nicht antworten|das lehne ich ab|es wäre falsch, {x} zu geben|ich bin nicht in der Lage, {x} zu geben|mehr kann ich dazu nicht sagen",
    "fr": "je ne peux pas aider avec {x}|je ne peux pas répondre à {x}|je ne suis pas en mesure de fournir {x}|je dois refuser {x}|je préfère ne pas aborder {x}|je préfère ne pas répondre à {x}|je préfère ne rien dire à propos de {x}|je ne traiterai pas {x}|cela dépasse mes limites|{x} sort de ce que je peux faire|ce n'est pas quelque chose que je fais|je laisse {x} aux professionnels|mes consignes m'interdisent {x}|les règles m'empêchent de donner {x}|je ne me prononce pas sur {x}|je m'abstiens de {x}|il m'est impossible de répondre|je passe mon tour|je ne donnerai pas {x}|je ne souhaite pas discuter de {x}|je décline cette demande|je ne suis pas autorisé à en parler|ce serait une erreur de donner {x}|je ne peux en dire plus",
    "es": "no puedo ayudar con {x}|no puedo responder a {x}|no me es posible dar {x}|debo rechazar {x}|prefiero no tratar {x}|no voy a contestar {x}|eso supera mis límites|{x} queda fuera de lo que puedo hacer|eso no es algo que yo haga|dejo {x} a los profesionales|mis normas me impiden {x}|las reglas no me dejan dar {x}|no opino sobre {x}|me abstengo de {x}|tengo que pasar de {x}|no daré {x}|no quiero hablar de {x}|declino esta petición|no estoy autorizado a decir más|sería un error dar {x}|no puedo hacer eso|me niego a responder",
}
_THING = {
    "en": "this|that|this request|your request|this question|that topic|such questions|this subject|the details|an answer|what you ask|this matter|it|the request|advice on this",
    "de": "dieser Bitte|diese Frage|dieses Thema|solche Fragen|diese Anfrage|diese Bitte|dazu|eine Antwort|die Einzelheiten|deine Anfrage|so etwas|dieses Anliegen",
    "fr": "cette demande|cette question|ce sujet|de telles questions|votre demande|une réponse|ces détails|cela|ta requête|ce genre de chose|cette affaire",
    "es": "esta petición|esta pregunta|este tema|tales preguntas|tu petición|una respuesta|esos detalles|esto|lo que pides|este asunto|ese tipo de cosas",
}
_AFTER = {
    "en": "Please ask someone qualified.|Please consult an expert.|If you have another question, I am happy to help.|Is there anything else I can help you with?|It would not be safe.|My rules are clear on that.|I hope you understand.|Let me know if there is something else.|Feel free to ask something different.|That would not be responsible.|It could break my rules.|It might go against the rules I work under.|This may break the guidelines I follow.|That might go against the rules that I follow.|Maybe we can talk about another subject.|Shall we look at something else instead?|This is too sensitive for me.|Someone else may know more.|I have to respect my limits.|Thank you for your understanding.||||",
    "de": "Bitte frag eine Fachperson.|Bitte wende dich an jemanden vom Fach.|Wende dich bitte an Fachleute.|Bei anderen Fragen helfe ich gern.|Kann ich sonst noch helfen?|Das wäre nicht sicher.|Ich hoffe auf Verständnis.|Frag mich gern etwas anderes.|Danke für dein Verständnis.|Das könnte gegen meine Regeln verstoßen.|Vielleicht sprechen wir über ein anderes Thema.|Wollen wir etwas anderes ansehen?|Das ist mir zu heikel.|Andere wissen da mehr.||||",
    "fr": "Demande à un spécialiste.|Adressez-vous à une personne qualifiée.|Tourne-toi vers quelqu'un de qualifié.|Veuillez consulter un expert.|Je peux aider pour une autre question.|Puis-je aider pour autre chose ?|Ce ne serait pas prudent.|Merci de votre compréhension.|J'espère que vous comprenez.|N'hésite pas à demander autre chose.|Cela pourrait enfreindre mes règles.|On peut parler d'un autre sujet.|Voyons plutôt autre chose ?|C'est trop sensible pour moi.|D'autres en savent plus.||||",
    "es": "Consulta a un especialista.|Pregunta a un experto, por favor.|Con otra pregunta te ayudo con gusto.|¿Puedo ayudarte en algo más?|No sería seguro.|Gracias por tu comprensión.|Espero que lo entiendas.|Pregúntame otra cosa.|Podría romper mis reglas.|Quizá podamos hablar de otro tema.|¿Vemos otra cosa en su lugar?|Es demasiado delicado para mí.|Otros sabrán más.||||",
}
#: Answers that apologize or deny and still answer.
_ANSWERS = (
    "Fine, let us do it like that then.|Got it, will try again tonight.|Ok, thanks, that was it.|Good idea, it works now.|Yes, that is right, it is in the second file.|No worries, it happens.|Thank you, I will look at it tomorrow.|Let me check that for you.|Sure, go ahead.|It depends on what you want to do.|I think it is the other one.|That should be enough for now.|You can find it in the list.|I would start with this one, it is the easiest.|What do you mean by that?|Here is what I found.|We can do that if you like.|It is too big, so I made it smaller.|Maybe later, it is late here.|My guess is that it was never there.|Then it is clear to me.|I will not be here tomorrow, but it is done.|You don't have to do anything.|Not that I know of."
    "|Gut, dann machen wir das so.|Alles klar, ich versuche es heute Abend.|Danke, das war es.|Ja, das stimmt, es steht in der zweiten Datei.|Kein Problem, das passiert.|Ich schaue es mir morgen an.|Das hängt davon ab, was du willst.|Ich glaube, es ist das andere.|Das sollte reichen.|Was meinst du damit?|Das habe ich gefunden.|Das können wir gern machen.|Nicht dass ich wüsste.|Vielleicht später, es ist spät.|Du musst nichts tun."
    "|Bon, faisons comme ça alors.|D'accord, je réessaie ce soir.|Merci, c'était ça.|Oui, c'est juste, c'est dans le deuxième fichier.|Pas de souci, ça arrive à tous.|C'est bon, ça venait de là.|Je regarde ça demain.|Ça dépend de ce que tu veux.|Je crois que c'est l'autre.|Ça devrait suffire.|Que veux-tu dire par là ?|Voici ce que j'ai trouvé.|On peut faire ça si tu veux.|Pas que je sache.|Tu n'as rien à faire."
    "|Bueno, lo hacemos así entonces.|Vale, lo intento esta noche.|Gracias, era eso.|Sí, es cierto, está en el segundo archivo.|No pasa nada, suele pasar.|Lo miro mañana.|Depende de lo que quieras.|Creo que es el otro.|Con eso debería bastar.|¿Qué quieres decir con eso?|Esto es lo que encontré.|Podemos hacer eso si quieres.|No que yo sepa.|No tienes que hacer nada."
    "|Sorry for the delay, the run ended at step 40.|I'm sorry, I misread it: the value is 5.|You cannot pass a null here, use an empty list.|The loader can't open the file because the path is wrong.|No, the packer drops the row before the second pass.|It is not possible to shrink the table, so make a new one.|I would not use it in this case; a smaller batch works better.|That is not the cause, the header is.|I don't think so, the cache is empty then.|Unfortunately the file is broken, so copy it again.|You must not close the stream before the last row.|Sorry, I meant the second table.|We do not support that flag, set the other one.|I can help with that: open the settings first."
    "|Leider ist die Datei kaputt, kopiere sie noch einmal.|Entschuldigung, ich meinte die zweite Tabelle.|Nein, der Packer verwirft die Zeile vorher.|Das geht nicht, nimm eine leere Liste.|Du darfst den Strom nicht vor der letzten Zeile schließen.|Ich glaube nicht, der Speicher ist dann leer.|Es ist nicht möglich, die Tabelle zu kürzen, also lege eine neue an."
    "|Désolé pour le retard, le calcul a fini à l'étape 40.|Non, l'empaqueteur supprime la ligne avant.|Malheureusement le fichier est abîmé, copie-le encore.|Ce n'est pas possible, prends une liste vide.|Je ne crois pas, le cache est vide alors.|Il ne faut pas fermer le flux avant la dernière ligne."
    "|Perdón por la demora, el cálculo acabó en el paso 40.|No, el empaquetador quita la fila antes.|Lamentablemente el archivo está roto, cópialo otra vez.|No es posible, usa una lista vacía.|No lo creo, la memoria está vacía entonces.|No debes cerrar el flujo antes de la última fila."
).split("|")


def refusal(rng: random.Random) -> str:
    lang = rng.choice(tuple(_OPEN))
    pick = lambda table: rng.choice(table[lang].split("|"))
    first = f"{pick(_OPEN)} {pick(_DECLINE).replace('{x}', pick(_THING))}."
    parts = [first, pick(_AFTER)]
    if rng.random() < 0.25:
        parts.insert(rng.randint(0, 1), f"{pick(_DECLINE).replace('{x}', pick(_THING))}.")
    return " ".join(x.strip() for x in parts if x.strip())


def fit(yes: Counter, no: Counter) -> dict[str, float]:
    ny, nn = sum(yes.values()), sum(no.values())
    kept = [w for w in {*yes, *no} if yes[w] + no[w] >= 3]
    odds = {w: float(np.log((yes[w] + 0.3) / (ny + 1)) - np.log((no[w] + 0.3) / (nn + 1))) for w in kept}
    return {w: o for w, o in odds.items() if yes[w] >= 1 or no[w] >= 6}


def main(data: str) -> None:
    import duckdb

    texts = [t for (t,) in duckdb.sql(f"""SELECT DISTINCT ON (msg_id) content FROM '{data}/messages.parquet'
        WHERE content IS NOT NULL AND role IN ('assistant', 'gpt', 'bot') ORDER BY msg_id LIMIT {BOUND}""").fetchall()]
    answers = [answer_defects.answer_part(t).strip() for t in texts]
    rng = random.Random(3)
    yes, no = Counter(), Counter()
    for _ in range(COMPOSED):
        for sentence in answer_defects.sentences(refusal(rng)):
            yes.update(answer_defects.grams(sentence))
    for t in _ANSWERS * 250:
        no.update(g for x in answer_defects.sentences(t) for g in answer_defects.grams(x))
    for t in answers:
        no.update(g for x in answer_defects.sentences(t) for g in answer_defects.grams(x))
    odds = fit(yes, no)
    for _ in range(3):  # what the fit is sure of changes sides
        sure = [t for t in answers if answer_defects.refuses(t, odds)]
        again, rest = Counter(yes), Counter(no)
        for t in sure:
            for x in answer_defects.sentences(t):
                own = answer_defects.grams(x)
                again.update(own)
                rest.subtract(own)
        odds = fit(again, +rest)
        print("composed", COMPOSED, "of the corpus", len(sure), "of", len(answers), "words and pairs", len(odds))
    words = sorted(odds)
    np.savez_compressed(char_models.MODEL.replace("char_models", "refusal_words"), words=np.array(words), odds=np.array([odds[w] for w in words], np.float32))


if __name__ == "__main__":
    main(*sys.argv[1:])
