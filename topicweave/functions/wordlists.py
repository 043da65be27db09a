"""Fixed word lists used by cleaning and by free-text queries."""

from __future__ import annotations

# English stop words (the list the cleaning results rest on).
ENGLISH_STOP_WORDS = """
i me my myself we our ours ourselves you you're you've you'll you'd your yours
yourself yourselves he him his himself she she's her hers herself it it's its
itself they them their theirs themselves what which who whom this that that'll
these those am is are was were be been being have has had having do does did
doing a an the and but if or because as until while of at by for with about
against between into through during before after above below to from up down
in out on off over under again further then once here there when where why how
all any both each few more most other some such no nor not only own same so
than too very s t can will just don don't should should've now d ll m o re ve y
ain aren aren't couldn couldn't didn didn't doesn doesn't hadn hadn't hasn
hasn't haven haven't isn isn't ma mightn mightn't mustn mustn't needn needn't
shan shan't shouldn shouldn't wasn wasn't weren weren't won won't wouldn
wouldn't
""".split()

# Spanish stop words (the public list that Spark ML ships, in its order).
SPANISH_STOP_WORDS = """
de la que el en y a los del se las por un para con no una su al lo como más pero sus le
ya o este sí porque esta entre cuando muy sin sobre también me hasta hay donde quien
desde todo nos durante todos uno les ni contra otros ese eso ante ellos e esto mí antes
algunos qué unos yo otro otras otra él tanto esa estos mucho quienes nada muchos cual
poco ella estar estas algunas algo nosotros mi mis tú te ti tu tus ellas nosotras
vosostros vosostras os mío mía míos mías tuyo tuya tuyos tuyas suyo suya suyos suyas
nuestro nuestra nuestros nuestras vuestro vuestra vuestros vuestras esos esas estoy
estás está estamos estáis están esté estés estemos estéis estén estaré estarás estará
estaremos estaréis estarán estaría estarías estaríamos estaríais estarían estaba estabas
estábamos estabais estaban estuve estuviste estuvo estuvimos estuvisteis estuvieron
estuviera estuvieras estuviéramos estuvierais estuvieran estuviese estuvieses
estuviésemos estuvieseis estuviesen estando estado estada estados estadas estad he has
ha hemos habéis han haya hayas hayamos hayáis hayan habré habrás habrá habremos habréis
habrán habría habrías habríamos habríais habrían había habías habíamos habíais habían
hube hubiste hubo hubimos hubisteis hubieron hubiera hubieras hubiéramos hubierais
hubieran hubiese hubieses hubiésemos hubieseis hubiesen habiendo habido habida habidos
habidas soy eres es somos sois son sea seas seamos seáis sean seré serás será seremos
seréis serán sería serías seríamos seríais serían era eras éramos erais eran fui fuiste
fue fuimos fuisteis fueron fuera fueras fuéramos fuerais fueran fuese fueses fuésemos
fueseis fuesen sintiendo sentido sentida sentidos sentidas siente sentid tengo tienes
tiene tenemos tenéis tienen tenga tengas tengamos tengáis tengan tendré tendrás tendrá
tendremos tendréis tendrán tendría tendrías tendríamos tendríais tendrían tenía tenías
teníamos teníais tenían tuve tuviste tuvo tuvimos tuvisteis tuvieron tuviera tuvieras
tuviéramos tuvierais tuvieran tuviese tuvieses tuviésemos tuvieseis tuviesen teniendo
tenido tenida tenidos tenidas tened
""".split()

# Extra stop words of the cleaning step.
CLEANING_EXTRA_STOP_WORDS = [
    "http", "https", "co", "vía", "rt", "así", "por", "tan", "si", "según",
    "tras", "via", "``", "`",
]

# Extra stop words of free-text queries.
QUERY_EXTRA_STOP_WORDS = [
    "si", "RT", "rt", "via", "https", "http", "jaja", "jajaja", "aún",
]

# ASCII punctuation. A token is dropped when it occurs as a
# contiguous run of this string.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

# Happy and sad emoticons.
HAPPY_EMOTICONS = [
    ":-)", ":)", ";)", ":o)", ":]", ":3", ":c)", ":>", "=]", "8)", "=)", ":}",
    ":^)", ":-D", ":D", "8-D", "8D", "x-D", "xD", "X-D", "XD", "=-D", "=D",
    "=-3", "=3", ":-))", ":'-)", ":')", ":*", ":^*", ">:P", ":-P", ":P", "X-P",
    "x-p", "xp", "XP", ":-p", ":p", "=p", ":-b", ":b", ">:)", ">;)", ">:-)",
    "<3",
]
SAD_EMOTICONS = [
    ":L", ":-/", ">:/", ":S", ">:[", ":@", ":-(", ":[", ":-||", "=L", ":<",
    ":-[", ":-<", "=\\", "=/", ">:(", ":(", ">.<", ":'-(", ":'(", ":\\", ":-c",
    ":c", ":{", ">:\\", ";(",
]
EMOTICONS = HAPPY_EMOTICONS + SAD_EMOTICONS


def cleaning_stop_words() -> list[str]:
    return sorted({*ENGLISH_STOP_WORDS, *SPANISH_STOP_WORDS, *CLEANING_EXTRA_STOP_WORDS})


def query_stop_words() -> list[str]:
    return sorted(
        {*ENGLISH_STOP_WORDS, *SPANISH_STOP_WORDS, *PUNCTUATION, *QUERY_EXTRA_STOP_WORDS}
    )
