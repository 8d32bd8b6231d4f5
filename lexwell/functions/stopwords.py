"""Stop words of fifteen languages; function words, never applied to the base tokens."""

from __future__ import annotations

# The words of each language. They must equal the lists of the engine whose results are matched.
_WORDS = {
    "de": (
        "aber alle allem allen aller alles als also am an auch auf aus bei beim bin bis bist da damit dann darf das daß dass "
        "dasselbe dazu dein deine deinem deinen deiner deines dem den denn der derselbe des dich die dies diese dieselbe diesem "
        "diesen dieser dieses dir doch dort du durch dürfen ein eine einem einen einer eines einmal er es etwas euch euer eure "
        "eurem euren eurer eures für gegen gewesen habe haben habt hast hat hatte hatten hattest hattet hier hin hinter ich ihm "
        "ihn ihnen ihr ihre ihrem ihren ihrer ihres im in indem ins ist jede jedem jeden jeder jedes jene jenem jenen jener jenes "
        "jetzt kann kannst kein keine keinem keinen keiner keines können könnt könnte mag man manche manchem manchen mancher "
        "manches mein meine meinem meinen meiner meines mich mir mit möchte mögen muss müssen musst müsst musste nach neben nicht "
        "nichts noch nun nur ob obwohl oder ohne schon sehr sei seid sein seine seinem seinen seiner seines seit selbst sich sie "
        "sind so solche solchem solchen solcher solches soll sollen sollst sollte sondern sonst sowie über um und uns unser "
        "unsere unserem unseren unserer unseres unter vom von vor während wann war waren warst wart warum was weg wegen weil "
        "weiter welche welchem welchen welcher welches wenn wer werde werden werdet wie wieder will willst wir wird wirst wo "
        "wollen wollte wurde würde wurden würden zu zum zur zwar zwischen "
    ),
    "en": (
        "a an the this that these those each every either neither some any no all both few more most much many other another such "
        "own same i me my mine myself you your yours yourself yourselves he him his himself she her hers herself it its itself we "
        "us our ours ourselves they them their theirs themselves who whom whose which what am is are was were be been being have "
        "has had having do does did doing done will would shall should can could may might must of in on at by for with about "
        "against between among into through during before after above below to from up down out off over under again further "
        "without within along across behind near upon since until and but or nor so yet if then else because as while when where "
        "why how although though unless whether not only just very too also here there once now ever never always often still "
        "even don doesn didn isn aren wasn weren hasn haven hadn won wouldn shouldn couldn ll re ve "
    ),
    "fr": (
        "au aux le la les un une des du de c d j l m n qu s t ce cet cette ces ceci cela elle elles il ils je tu nous vous on me "
        "te se moi toi soi lui leur eux y en qui que quoi dont où ma mon mes ta ton tes sa son ses notre nos votre vos leurs à "
        "dans par pour sur sous avec sans chez entre vers et ou mais donc or ni car si comme quand ne pas plus même aussi très "
        "tout toute tous toutes été étée étées étés étant suis es est sommes êtes sont serai seras sera serons serez seront "
        "serais serait serions seriez seraient étais était étions étiez étaient fus fut fûmes fûtes furent sois soit soyons soyez "
        "soient fusse fusses fût fussions fussiez fussent être ayant eu eue eues eus ai as avons avez ont aurai auras aura aurons "
        "aurez auront aurais aurait aurions auriez auraient avais avait avions aviez avaient eut eûmes eûtes eurent aie aies ait "
        "ayons ayez aient eusse eusses eût eussions eussiez eussent avoir "
    ),
    "es": (
        "el la los las un una unos unas lo al del este esta estos estas ese esa esos esas aquel aquella aquellos aquellas esto "
        "eso aquello yo tú él ella ello nosotros nosotras vosotros vosotras ellos ellas usted ustedes me te se nos os le les mí "
        "ti sí quien quienes que qué cual cuales cuyo cuya mi mis tu tus su sus mío mía míos mías tuyo tuya tuyos tuyas suyo suya "
        "suyos suyas nuestro nuestra nuestros nuestras vuestro vuestra vuestros vuestras a ante bajo con contra de desde durante "
        "en entre hacia hasta para por según sin sobre tras y e o u ni pero sino porque como cuando donde si no más menos muy ya "
        "también tampoco todo toda todos todas otro otra otros otras mucho mucha muchos muchas poco poca pocos pocas tanto tanta "
        "algo nada cada tal hay ser soy eres es somos sois son sea seas seamos sean seré serás será seremos serán era eras éramos "
        "eran fui fuiste fue fuimos fueron fuera fueras fueran siendo sido estar estoy estás está estamos estáis están estaba "
        "estaban estado estando estuvo haber he has ha hemos habéis han haya hayan habrá había habían hube hubo habiendo habido "
    ),
    "it": (
        "il lo la i gli le un uno una l ad al allo ai agli all agl alla alle con col coi da dal dallo dai dagli dall dagl dalla "
        "dalle di del dello dei degli dell degl della delle in nel nello nei negli nell negl nella nelle su sul sullo sui sugli "
        "sull sugl sulla sulle per tra fra contro io tu lui lei noi voi loro mi ti ci vi li ne si che chi cui mio mia miei mie "
        "tuo tua tuoi tue suo sua suoi sue nostro nostra nostri nostre vostro vostra vostri vostre questo questi questa queste "
        "quello quelli quella quelle e ed o ma se perché anche come dove dov non più quale quanto quanti quanta quante tutto "
        "tutti tutta tutte a c è sì avere ho hai ha abbiamo avete hanno abbia abbiate abbiano avrò avrai avrà avremo avrete "
        "avranno avrei avresti avrebbe avevo avevi aveva avevamo avevano ebbi ebbe ebbero avendo avuto essere sono sei siamo "
        "siete sia siate siano sarò sarai sarà saremo sarete saranno sarei saresti sarebbe ero eri era eravamo erano fui fosti fu "
        "fummo furono fossi fosse fossero essendo stato stata stati state "
    ),
    "pt": (
        "o a os as um uma uns umas ao aos à às do da dos das no na nos nas num numa pelo pela pelos pelas dele dela deles delas "
        "eu tu ele ela nós vós eles elas você vocês me te se lhe lhes vos mim ti si que quem qual cujo cuja meu minha meus minhas "
        "teu tua teus tuas seu sua seus suas nosso nossa nossos nossas vosso vossa vossos vossas este esta estes estas esse essa "
        "esses essas aquele aquela aqueles aquelas isto isso aquilo de em por para com sem sob sobre entre até desde contra "
        "perante e ou nem mas porém porque como quando onde não sim mais menos muito muita muitos muitas pouco pouca poucos "
        "poucas também só já ainda depois antes mesmo mesma todo toda todos todas outro outra outros outras cada há ser sou és é "
        "somos sois são era eram éramos fui foi fomos foram fosse fossem seja sejam serei será seremos serão seria seriam sendo "
        "sido estar estou está estás estamos estão estava estavam estive esteve estivemos estiveram estando estado ter tenho tens "
        "tem têm temos tinha tinham tive teve tivemos tiveram tendo tido haver hei havemos hão havia houve "
    ),
    "nl": (
        "de en van ik te dat die in een hij het niet zijn is was op aan met als voor had er maar om hem dan zou of wat mijn men "
        "dit zo door over ze zich bij ook tot je mij uit der daar haar naar heb hoe heeft hebben deze u want nog zal me zij nu ge "
        "geen omdat iets worden toch al waren veel meer doen toen moet ben zonder kan hun dus alles onder ja eens hier wie werd "
        "altijd doch wordt wezen kunnen ons zelf tegen na reeds wil kon niets uw iemand geweest andere "
    ),
    "sv": (
        "och det att i en jag hon som han på den med var sig för så till är men ett om hade de av icke mig du henne då sin nu har "
        "inte hans honom skulle hennes där min man ej vid kunde något från ut när efter upp vi dem vara vad över än dig kan sina "
        "här ha mot alla under någon eller allt mycket sedan ju denna själv detta åt utan varit hur ingen mitt ni bli blev oss "
        "din dessa några deras blir mina samma vilken er sådan vår blivit dess inom mellan sådant varför varje vilka ditt vem "
        "vilket sitta sådana vart dina vars vårt våra ert era vilkas "
    ),
    "no": (
        "og i jeg det at en et den til er som på de med han av ikke ikkje der så var meg seg men ett har om vi min mitt ha hadde "
        "hun nå over da ved fra du ut sin dem oss opp man kan hans hvor eller hva skal selv sjøl her alle vil bli ble blei blitt "
        "kunne inn når være kom noen noe ville dere deres kun ja etter ned skulle denne for deg si sine sitt mot å meget hvorfor "
        "dette disse uten hvordan ingen din ditt blir samme hvilken hvilke sånn inni mellom vår hver hvem hvis både bare enn "
        "fordi før mange også slik vært begge siden dei deira deim eg ein eit elles ho henne hennes hennar honom hjå korleis kva "
        "kven kvifor me medan mi mine mykje no nokon noko nokre sidan so somme um upp vere vore verte vart "
    ),
    "da": (
        "og i jeg det at en den til er som på de med han af for ikke der var mig sig men et har om vi min havde ham hun nu over "
        "da fra du ud sin dem os op man hans hvor eller hvad skal selv her alle vil blev kunne ind når være dog noget ville jo "
        "deres efter ned skulle denne end dette mit også under have dig anden hende mine alt meget sit sine vor mod disse hvis "
        "din nogle hos blive mange ad bliver hendes været thi jer sådan "
    ),
    "fi": (
        "olla olen olet on olemme olette ovat ole oli olisi olisit olisin olisimme olisitte olisivat olit olin olimme olitte "
        "olivat ollut olleet en et ei emme ette eivät minä minun minut minua minussa minusta minuun minulla minulta minulle sinä "
        "sinun sinut sinua sinussa sinusta sinuun sinulla sinulta sinulle hän hänen hänet häntä hänessä hänestä häneen hänellä "
        "häneltä hänelle me meidän meidät meitä meissä meistä meihin meillä meiltä meille te teidän teidät teitä teissä teistä "
        "teihin teillä teiltä teille he heidän heidät heitä heissä heistä heihin heillä heiltä heille tämä tämän tätä tässä tästä "
        "tähän tällä tältä tälle tuo tuon tuota tuosta tuohon tuolla se sen sitä siinä siitä siihen sillä siltä sille siksi nämä "
        "näiden näitä näissä näistä näihin näillä näiltä näille nuo ne niiden niitä niissä niistä niihin niillä niiltä niille "
        "kuka kenen mikä minkä mitä missä mistä mihin millä miksi mitkä joka jonka jota jossa josta johon jolla jolta jolle jotka "
        "että ja jos joten koska kuin mutta niin sekä tai vaan vai vaikka kun nyt itse "
    ),
    "ru": (
        "и в во не что он на я с со как а то все она так его но да ты к у же вы за бы по только ее мне было вот от меня еще нет о "
        "из ему теперь когда даже ну вдруг ли если уже или ни быть был него до вас нибудь опять уж вам сказал ведь там потом себя "
        "ничего ей может они тут где есть надо ней для мы тебя их чем была сам чтоб без будто человек чего раз тоже себе под "
        "жизнь будет ж тогда кто этот говорил того потому этого какой совсем ним здесь этом один почти мой тем чтобы нее кажется "
        "сейчас были куда зачем сказать всех никогда сегодня можно при наконец два об другой хоть после над больше тот через эти "
        "нас про всего них какая много разве сказала три эту моя впрочем хорошо свою этой перед иногда лучше чуть том нельзя "
        "такой им более всегда конечно всю между "
    ),
    "hu": (
        "a ahogy ahol aki akik akkor alatt által általában amely amelyek amelyet amelynek ami amit amíg amikor át abban ahhoz "
        "annak arra arról az azok azon azt azzal azért aztán azután azonban bár be belül benne csak de e eddig egész egy egyes "
        "egyéb egyik egyre ekkor el elég ellen elő először előtt én éppen ebben ehhez ennek erre ez ezt ezek ezen ezzel ezért és "
        "fel felé hanem hiszen hogy hogyan igen így illetve ilyen ismét itt kell kellett keresztül ki kívül között közül legalább "
        "lehet legyen lenne lenni lesz lett maga magát majd már más másik meg még mellett mert mely melyek mi mit míg miért "
        "milyen mikor minden mindent mindenki mindig mint mintha mivel most ne néha nekem neki nem néhány nélkül nincs olyan ott "
        "össze ő ők őket pedig persze rá s saját sem semmi számára szemben szerint szinte talán tehát tovább továbbá több úgy "
        "ugyanis után utána vagy vagyis valaki valami valamint való vagyok van vannak volt voltam voltak voltunk vissza vele "
        "viszont volna "
    ),
    "ro": (
        "a abia acea această aceasta aceea acel acela acele acelea acest acesta aceste acestea acestei acestor acestui acolo ai "
        "aici al ale alt alta altă alte alți alţi altul am apoi ar are aș aş așa aşa ași aşi asupra atât ați aţi au având avea "
        "aveam avem aveți aveţi avut azi că ca căci când care cărei căror cărui cât câtă câte câți câţi câțiva câţiva către ce "
        "ceva chiar ci cine cineva cu cum da dacă dar de deci deoarece deși deşi despre din dintr doar după e ea ei el ele era "
        "erai eram erați eraţi erau este ești eşti eu fără fi fie fiecare fii fiind fiindcă fim fiți fiţi fiu foarte fost iar "
        "ieri îi îl îmi în încă încât însă într între întrucât îți îţi la lângă le li lor lui mă mai mâine mea mei mele meu mie "
        "mine ne nimeni nimic niște nişte noastră noastre noi noștri noştri nostru nu o ori oricare orice până pe pentru peste "
        "prea prin printr sa săi sale său sau se și şi sine sînt sîntem sînteți spre sub sunt suntem sunteți sunteţi ta tăi tale "
        "tău te tine toată toate tot toți toţi totul tu un una unde unei unor unui vă va vei veți veţi voastră voastre voi vom "
        "vor voștri voştri vostru "
    ),
    "tr": (
        "acaba ama ancak arada aslında ayrıca bana bazı belki ben benden beni benim beri bile bir birçok biri birkaç birşey biz "
        "bize bizden bizi bizim böyle böylece bu buna bunda bundan bunlar bunları bunların bunu bunun burada çok çünkü da daha "
        "dahi de defa değil diğer diye dolayı dolayısıyla eğer en fakat gibi göre hala hangi hatta hem henüz hep hepsi her "
        "herhangi herkes hiç hiçbir için ile ilgili ise işte itibaren itibariyle kadar karşın kendi kendine kendini kez ki kim "
        "kimden kime kimi kimse mı mi mu mü nasıl ne neden nedenle nerde nerede nereye niçin niye o olan olarak oldu olduğu olmak "
        "olması olsa olsun olup olur ona ondan onlar onlardan onları onların onu onun oysa öyle pek rağmen sadece sanki sen "
        "senden seni senin siz sizden sizi sizin şey şeyler şöyle şu şuna şunu tarafından tüm üzere var vardı ve veya ya yani "
        "yine yoksa zaten "
    ),
}
STOP_WORDS: dict[str, frozenset[str]] = {language: frozenset(words.split()) for language, words in _WORDS.items()}
