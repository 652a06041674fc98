"""Word lists and dictionaries (fixed values: results depend on them as they stand)."""

from __future__ import annotations

#: word -> (sound, meaning, respelling) of each reading.
HETERONYMS = {
    "wind": (("wɪnd", "air in motion", "winned"), ("waɪnd", "to twist round", "wined")),
    "read": (("riːd", "now or later", "reed"), ("rɛd", "already done", "red")),
    "lead": (("liːd", "to guide", "leed"), ("lɛd", "heavy metal", "led")),
    "tear": (("tɪr", "drop from the eye", "teer"), ("tɛr", "to pull apart", "tair")),
    "live": (("lɪv", "to have life", "liv"), ("laɪv", "as it happens", "lyve")),
    "lives": (("lɪvz", "dwells", "livz"), ("laɪvz", "more than one life", "lyves")),
    "bow": (("baʊ", "to bend down", "bough"), ("boʊ", "knot, or archer's weapon", "beau")),
    "wound": (("wuːnd", "a hurt", "woond"), ("waʊnd", "twisted round", "wowned")),
    "bass": (("beɪs", "deep tone", "base"), ("bæs", "a fish", "bas")),
    "close": (("kloʊs", "not far", "cloce"), ("kloʊz", "to shut", "cloze")),
    "desert": (("ˈdɛzərt", "dry land", "dezzurt"), ("dɪˈzɜːrt", "to leave behind", "dessert")),
    "dove": (("dʌv", "a pigeon", "duv"), ("doʊv", "went headlong", "dohve")),
    "minute": (("ˈmɪnɪt", "sixty seconds", "minnit"), ("maɪˈnuːt", "very small", "mynoot")),
    "object": (("ˈɒbdʒɪkt", "a thing", "objekt"), ("əbˈdʒɛkt", "to disagree", "ubject")),
    "present": (("ˈprɛzənt", "a gift, or here", "prezzunt"), ("prɪˈzɛnt", "to hand over", "prizent")),
    "produce": (("ˈproʊduːs", "fruit and vegetables", "prohduce"), ("prəˈduːs", "to make", "pruhdoose")),
    "record": (("ˈrɛkərd", "what is kept", "reckurd"), ("rɪˈkɔːrd", "to keep a sound", "ricord")),
    "refuse": (("rɪˈfjuːz", "to decline", "refyooz"), ("ˈrɛfjuːs", "rubbish", "refyoos")),
    "use": (("juːz", "to employ", "yooz"), ("juːs", "the purpose", "yoose")),
    "house": (("haʊs", "a building", "howse"), ("haʊz", "to give shelter", "howze")),
    "polish": (("ˈpɒlɪʃ", "to make shine", "pollish"), ("ˈpoʊlɪʃ", "of Poland", "poelish")),
    "resume": (("rɪˈzuːm", "to go on", "rizoom"), ("ˈrɛzjʊmeɪ", "a summary of work", "rezoomay")),
}
#: respelling -> word.
RESPELLINGS = {say: word for word, readings in HETERONYMS.items() for _, _, say in readings if say != word}

#: Fixed values from here on: words that are no names, titles, interjections, verbs of speech and endings.
PRONOUNS = [
    "he", "she", "they", "him", "her", "them", "i", "you", "we", "it", "someone", "somebody", "who", "that", "this",
]
NOT_NAMES = [
    "he", "she", "they", "him", "her", "them", "it", "i", "you", "we", "us", "his", "hers", "theirs", "someone", "somebody", "anyone", "everyone",
    "no one", "nobody", "a voice", "the voice", "voice", "both", "all", "another", "the other", "the others", "unknown", "unnamed", "unidentified",
    "narrator", "n/a", "none", "null", "?",
]
BLOCKED = [
    "hello", "hi", "hey", "hiya", "howdy", "greetings", "goodbye", "bye", "good morning", "good evening", "good night", "goodnight", "morning", "hm",
    "hmm", "hmmm", "hrm", "mm", "mmm", "mhm", "mmhmm", "um", "umm", "uh", "uhh", "er", "erm", "ah", "ahh", "aah", "oh", "ohh", "ooh", "oof", "whoa",
    "woah", "wow", "huh", "ugh", "argh", "aargh", "shh", "shhh", "psst", "phew", "ha", "hah", "heh", "hee", "yay", "ow", "ouch", "yeah", "yep", "yup",
    "nope", "nah", "aye", "okay", "ok", "alright", "yes", "no", "well", "what", "why", "wait", "stop", "sorry", "please", "thanks", "thank you",
    "sir", "maam", "madam", "madame", "mister", "miss", "missus", "sonny", "yessir", "nossir", "yessum", "shit", "damn", "dammit", "damnit", "hell",
    "crap", "ratshit", "gosh", "jeez", "geez", "christ", "jesus", "god", "oh god", "my god", "oh my god",
]
TITLES = [
    "mr", "mrs", "ms", "miss", "dr", "doctor", "sheriff", "deputy", "mayor", "governor", "senator", "congressman", "congresswoman", "judge",
    "officer", "captain", "lieutenant", "sergeant", "corporal", "major", "colonel", "general", "admiral", "professor", "reverend", "pastor", "lord",
    "lady", "sir", "dame", "master", "mistress", "king", "queen", "prince", "princess", "old", "young", "the",
]
HONORIFICS = [
    "mr", "mrs", "ms", "miss", "dr", "sir", "lady", "lord", "master", "mistress", "captain", "capt", "major", "colonel", "sergeant", "sgt",
    "governor", "mayor", "deputy", "sheriff", "judge", "father", "mother", "aunt", "uncle", "professor", "prof", "reverend", "saint", "st",
]
NUMBER_WORDS = [
    "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen",
    "seventeen", "eighteen", "nineteen", "twenty", "thirty", "forty", "fifty", "hundred", "first", "second", "third", "fourth", "fifth",
]
INTERJECTIONS = [
    "nossir", "yessir", "hrm", "hmm", "hm", "uh", "um", "er", "oh", "ah", "ha", "huh", "ugh", "hey", "well", "okay", "ok", "yes", "no", "nope",
    "yeah", "yep", "shit", "damn", "hell", "god", "christ", "jesus", "fuck", "ratshit", "aye", "nay",
]
NICK_ENDINGS = ("", "s", "es", "e", "ie", "ey", "y")
#: Verbs of a speech tag.
SAY_VERBS = [
    "said", "says", "asked", "replied", "answered", "shouted", "whispered", "muttered", "called", "added", "cried", "snapped", "murmured", "breathed",
    "hissed", "barked", "growled", "roared", "continued", "offered", "admitted", "agreed", "insisted", "repeated", "began", "told", "demanded",
    "observed", "noted", "remarked", "responded", "countered", "urged", "warned", "pleaded", "sighed", "laughed", "spat", "drawled", "put in",
    "went on", "wondered",
]
SAY = "|".join(SAY_VERBS)
#: Verbs that make a character one who speaks.
SPEAK_VERBS = [
    "say", "said", "says", "asked", "ask", "replied", "reply", "answered", "answer", "shouted", "whispered", "muttered", "called", "adds", "added",
    "cried", "snapped", "murmured", "breathed", "hissed", "barked", "growled", "roared", "continued", "offered", "admitted", "agreed", "insisted",
    "repeated", "began", "told", "demanded", "observed", "noted", "remarked", "responded", "countered", "urged", "warned", "pleaded", "sighed",
    "laughed", "spat", "drawled", "wondered", "screamed", "yelled", "gasped", "mumbled", "stammered", "exclaimed", "announced",
]
SAYS_AFTER = [
    "say", "said", "says", "asked", "replied", "answered", "shouted", "whispered", "muttered", "murmured", "exclaimed", "cried", "stammered",
    "mumbled", "called",
]
SAYS_BEFORE = [
    "say", "said", "says", "replied", "answered", "whispered", "muttered", "murmured", "exclaimed", "cried", "stammered", "mumbled", "shouted",
]
ONES = [
    "zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen",
    "sixteen", "seventeen", "eighteen", "nineteen",
]
TENS = [
    "twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety",
]
ABBREVIATIONS = "Mr|Mrs|Ms|Dr|Prof|St|Sr|Jr|vs|etc|i\\.e|e\\.g|No"
OPENING, CLOSING = "“‘«", "”’»"
