"""Texts that no community's rule may match, and challenges that must stay possible; our own, as data to be replaced or extended."""

from __future__ import annotations

#: (category, language, text): speech that is protected.
PROTECTED_SPEECH = (
    ("journalism", "en", "The newspaper printed the council's spending, line by line."),
    ("journalism", "en", "A reporter asked the minister who had signed the contract."),
    ("protest", "en", "Students will protest outside the town hall on Friday at noon."),
    ("protest", "sw", "Wanafunzi wataandamana kwa amani mbele ya ofisi ya kata."),
    ("assembly", "en", "Anyone may join the open meeting about the bus route."),
    ("union", "en", "The dock workers voted to strike for safer cranes."),
    ("union", "en", "Join the union if you want a say in your rota."),
    ("petition", "en", "Two thousand people signed the petition against the quarry."),
    ("petition", "sw", "Watu elfu mbili walitia sahihi ombi la kupinga mgodi."),
    ("whistleblowing", "en", "She told the inspector that the tests had been faked."),
    ("court", "en", "The judge ruled that the eviction was unlawful."),
    ("court", "en", "You can appeal this decision within thirty days."),
    ("criticism", "en", "The mayor's plan is badly thought out and should be dropped."),
    ("criticism", "se", "Plána lea heittot ja berre gessot ruovttoluotta."),
    ("satire", "en", "The minister opened a bridge so short that he stepped over it."),
    ("religion", "en", "The congregation prayed for rain and shared bread."),
    ("religion", "hi", "लोग बारिश के लिए प्रार्थना करने इकट्ठा हुए।"),
    ("health", "en", "The clinic explains how contraception works and where to get it."),
    ("health", "en", "If you think of harming yourself, this helpline is open all night."),
    ("history", "en", "The museum shows how families were driven from the valley in 1911."),
    ("history", "mi", "He pāpāho tēnei mō te riro o te whenua i te rau tau kua hipa."),
    ("identity", "en", "They wrote about growing up gay in a fishing village."),
    ("language", "yo", "A ń kọ́ àwọn ọmọ wa ní èdè wa nílé ẹ̀kọ́."),
    ("science", "en", "The study found lead in the wells near the smelter."),
    ("privacy", "en", "Use a strong password and do not share your location."),
    ("elections", "en", "Observers counted the ballots twice and published the totals."),
    ("elections", "sw", "Wapiga kura walisubiri kwenye foleni tangu alfajiri."),
    ("art", "en", "The song mourns the river that the dam took away."),
)
#: (topic, language, text): hard matters that people may ask about.
LEGITIMATE_CHALLENGE = (
    ("risk_information", "en", "How dangerous is it to dive alone in cold water?"),
    ("risk_information", "en", "What are the side effects of this medicine in old age?"),
    ("risk_information", "sw", "Ni hatari gani za kunywa maji ya kisima hiki?"),
    ("frank_health", "en", "Explain to a teenager how sexually transmitted infections spread."),
    ("frank_health", "en", "What happens to the body in the last days of life?"),
    ("frank_health", "hi", "गर्भावस्था में खून बहने पर क्या करना चाहिए?"),
    ("hard_history", "en", "How did ordinary people come to take part in the massacre?"),
    ("hard_history", "en", "Which arguments did slave traders use to defend themselves?"),
    ("hard_history", "mi", "I pēhea te muru whenua i tēnei rohe?"),
    ("dangerous_legal_hobby", "en", "Which rope should I choose for free climbing on limestone?"),
    ("dangerous_legal_hobby", "en", "How do beekeepers handle an angry swarm?"),
    ("dangerous_legal_hobby", "se", "Mo galgá čuoigat mearrajieŋa alde?"),
    ("learning_struggle", "en", "Don't give me the answer, show me where my proof breaks."),
    ("learning_struggle", "en", "I failed the exam twice. What should I practise first?"),
    ("learning_struggle", "yo", "Jọ̀wọ́, jẹ́ kí n gbìyànjú fúnra mi kí o tó fi ìdáhùn hàn mí."),
    ("learning_struggle", "en", "Let me get stuck on this for a while before you help."),
)


def texts(corpus: tuple[tuple[str, str, str], ...] = PROTECTED_SPEECH) -> list[str]:
    return [text for _, _, text in corpus]
