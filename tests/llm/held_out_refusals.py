"""Refusals and sound sentences that no part of ``qaloom.llm.refusals`` was changed for.

Both are by one author, the parts written first, so the shares found here are an
upper bound of what other people's phrasings would give.
"""

REFUSE = [
    "I'm afraid I can't help you with that one.", "Sorry, but I am not in a position to say anything about a patient's body.", "I must respectfully decline to respond.", "That is not something I'm able to assist with.", "My policy doesn't let me comment on surgery.", "I'd prefer not to answer this.",
    "We do not provide medical assessments of individual operations.", "It goes against my rules to interpret surgical video.", "As a language model I shouldn't be giving a diagnosis here.", "This question has to be turned down for reasons of privacy.", "I will have to pass on this request.", "Answering this would be beyond my remit.",
    "I don't feel comfortable judging this operation.", "Such matters are better left to trained surgeons.", "I am prohibited from discussing patient recordings.", "Unable to comply with this request.", "No comment.", "I really should not speculate about this patient.", "I can not in good conscience evaluate this recording.", "I have been instructed not to answer questions of this type.",
    "Diese Frage beantworte ich lieber nicht.", "Dabei kann ich Ihnen leider nicht behilflich sein.", "Meine Richtlinien untersagen mir eine Bewertung.", "Es ist mir nicht gestattet, Operationen zu kommentieren.", "Ich bin nicht befugt, hierzu etwas zu sagen.", "Zu medizinischen Bildern gebe ich grundsätzlich keine Auskunft.", "Ich möchte mich dazu nicht äußern.", "Ich lehne es ab, darauf zu antworten.", "Ihre Anfrage wird aus Datenschutzgründen abgelehnt.", "Das darf ich leider nicht bewerten.",
    "Je ne suis pas habilité à juger cette intervention.", "Je préfère ne pas répondre à cette question.", "Il m'est impossible de vous donner un avis médical.", "Je me dois de décliner.", "Mes consignes m'interdisent de commenter ces vidéos.", "Désolé, je ne saurais vous aider sur ce point.", "Votre demande est refusée pour des raisons de confidentialité.", "Je m'abstiens de tout commentaire.",
    "No estoy autorizada a emitir un juicio.", "Me temo que no puedo ayudarle con eso.", "Prefiero no contestar a esta pregunta.", "Mis normas me impiden comentar imágenes médicas.", "Me niego a responder.", "Tengo que declinar la petición.", "No me corresponde evaluar a un paciente.", "Su consulta ha sido rechazada por motivos de seguridad.",
    "Mi dispiace, non posso rispondere a questa domanda.", "Desculpe, não posso ajudar com isso.", "Sorry, ik kan deze vraag niet beantwoorden.", "Niestety nie mogę odpowiedzieć na to pytanie.", "Извините, я не могу ответить на этот вопрос.", "抱歉，我无法回答这个问题。",
]
SOUND = [
    "The guidelines do not allow a sponge to remain in the abdomen.", "The surgeon refuses to cut before the clip is placed.", "I cannot see the needle after 00:10:00.", "I can't make out any clip because smoke covers the lens.", "The assistant cannot reach the gallbladder with the grasper.", "The nurse was not able to find the second sponge.",
    "The trainee declines the hook and takes the scissors.", "It is not possible to tell the two clips apart in this frame.", "The clip is outside the view for most of the time.", "The monitor is not permitted inside the sterile field.", "The team would rather not open the bag before counting.", "The rules of the count require two readers.",
    "The answer is the sponge, as it stays longest in the picture.", "The first reader can help the second one with the count.", "I would say that the needle lies behind the left colon.", "Nothing is left to the trainee; the consultant does every step.", "I can't find a second clip in the segment.", "The request for a new bag came at 00:12:10.", "The surgeon will not leave the drain in place.", "We do not see the mesh before 00:03:00.",
    "Der Assistent kann die Nadel nicht fassen.", "Die Richtlinien verbieten es, ein Tuch im Bauch zu lassen.", "Ich sehe um 00:10:00 keine Nadel im Bild.", "Die Klammer lässt sich in diesem Abschnitt nicht erkennen.", "Die Chirurgin lehnt den Haken ab und nimmt die Schere.", "Das Tuch bleibt bis zum Ende nicht sichtbar.", "Der zweite Leser gibt keine andere Zahl an.", "Ich kann die Nadel wegen des Rauchs nicht erkennen.",
    "Le chirurgien refuse la pince et prend les ciseaux.", "On ne peut pas voir l'aiguille derrière le foie.", "Je ne vois aucun clip dans cette image.", "La compresse n'est pas visible après cette heure.", "L'assistant ne peut pas saisir le calcul.", "Les règles du comptage exigent deux lecteurs.",
    "La cirujana rechaza la pinza y pide las tijeras.", "No puedo ver la aguja detrás del hígado.", "No se distingue ninguna gasa en la imagen.", "El ayudante no puede alcanzar el cálculo.", "Las normas no permiten dejar una gasa en el abdomen.", "No hay ningún objeto en la imagen.",
]
