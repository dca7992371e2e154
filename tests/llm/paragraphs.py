"""Ordinary paragraphs of languages that have no band of their own, by code."""

PARAGRAPHS = {
    "it": "Ieri mattina siamo andati al mercato della piazza per comprare frutta e verdura fresca. Il venditore ci ha raccontato che quest'anno la pioggia ha rovinato gran parte del raccolto e che i prezzi sono saliti più del previsto. Dopo aver bevuto un caffè con gli amici, abbiamo deciso di tornare a casa a piedi lungo il fiume, perché il sole splendeva e l'aria era tiepida.",
    "pt": "Na semana passada a minha irmã começou a trabalhar numa pequena livraria perto da estação. Ela gosta muito de conversar com os clientes e de recomendar romances que leu quando era mais nova. O dono da loja disse que as vendas aumentaram desde que ela chegou e que pretende abrir outra loja no próximo ano, se tudo correr bem.",
    "nl": "De gemeente heeft besloten om het oude station volgend jaar te verbouwen tot een bibliotheek met een café en een grote tuin. Veel bewoners zijn blij met het plan, maar sommigen maken zich zorgen over het verkeer en de kosten. Tijdens de vergadering van gisteravond werd er lang gepraat over de vraag wie er voor het onderhoud moet betalen.",
    "sv": "Förra sommaren reste vi med tåg genom hela landet och stannade i små städer som vi aldrig hade besökt tidigare. Vädret var varmt och människorna vi träffade var vänliga och hjälpsamma. På kvällarna satt vi vid sjön, lagade mat över öppen eld och pratade om allt vi hade sett under dagen innan vi gick och lade oss.",
    "pl": "Wczoraj wieczorem poszliśmy do teatru, żeby zobaczyć nową sztukę młodego reżysera. Przedstawienie trwało ponad dwie godziny, ale nikt z widzów nie wyszedł przed końcem. Aktorzy grali bardzo dobrze, a muzyka i światło tworzyły niezwykły nastrój. W drodze do domu długo rozmawialiśmy o tym, co autor chciał nam powiedzieć.",
    "cs": "Minulý týden jsme se rozhodli, že strávíme víkend na horách a zkusíme najít cestu, o které nám vyprávěl dědeček. Počasí nám přálo a už v poledne jsme stáli na vrcholu, odkud bylo vidět celé údolí s řekou a malými vesnicemi. Večer jsme se vrátili unavení, ale spokojení, a uvařili jsme si polévku.",
    "tr": "Geçen hafta sonu ailemle birlikte deniz kenarındaki küçük bir köye gittik. Sabahları erkenden kalkıp sahilde yürüdük ve balıkçıların tekneleri hazırlamasını izledik. Öğleden sonra hava çok sıcak olduğu için evin bahçesinde oturup kitap okuduk. Akşam yemeğinde taze balık yedik ve komşularla uzun uzun sohbet ettik.",
    "fi": "Viime talvena järvi jäätyi niin aikaisin, että lapset pääsivät luistelemaan jo marraskuussa. Isä rakensi rannalle pienen laavun, jossa keitimme kahvia ja paistoimme makkaraa. Iltaisin taivas oli kirkas ja tähdet loistivat metsän yllä. Kaikki toivoivat, että kevät ei tulisi liian nopeasti, koska lumi teki kaikesta kaunista.",
    "ro": "În fiecare dimineață bunica mea se trezește înainte de răsăritul soarelui și merge în grădină să vadă ce flori au înflorit peste noapte. Apoi pregătește micul dejun pentru toată familia și ne povestește despre vremurile când era copilă. Ne place să o ascultăm, pentru că poveștile ei sunt pline de oameni și de locuri frumoase.",
    "hu": "Tegnap délután a barátaimmal elmentünk a könyvtárba, mert a tanárunk azt kérte, hogy írjunk egy rövid dolgozatot a város történetéről. Sok régi térképet és fényképet találtunk, amelyek megmutatták, hogyan éltek itt az emberek száz évvel ezelőtt. Estére elfáradtunk, de örültünk, hogy ennyi érdekes dolgot tanultunk.",
    "vi": "Sáng hôm qua, chúng tôi dậy sớm để đi chợ mua rau và cá tươi cho bữa cơm gia đình. Trời mưa nhẹ nhưng đường phố vẫn đông người qua lại. Bà tôi kể rằng ngày xưa chợ này chỉ có vài quầy hàng nhỏ, còn bây giờ người ta bán đủ mọi thứ từ quần áo đến đồ điện tử.",
    "id": "Setiap akhir pekan kami pergi ke rumah kakek yang terletak di kaki gunung. Di sana udaranya sejuk dan pemandangannya sangat indah. Kakek mengajari kami cara menanam padi, memberi makan ikan, dan memetik buah dari pohon yang tinggi. Pada malam hari kami duduk bersama di teras sambil mendengarkan cerita tentang masa mudanya.",
    "ru": "Вчера вечером мы долго гуляли по набережной и разговаривали о том, как изменился наш город за последние десять лет. На месте старого завода построили парк, где дети катаются на велосипедах, а взрослые читают книги на скамейках. Мне нравится, что здесь стало тише, хотя иногда я скучаю по шумным улицам своего детства.",
    "uk": "Минулого літа ми з друзями поїхали до невеликого села біля річки, щоб відпочити від міського шуму. Щоранку господиня пригощала нас свіжим молоком і теплим хлібом, а ввечері ми сиділи біля вогнища та співали пісні. Ніхто не хотів повертатися додому, бо там було так спокійно і гарно.",
    "el": "Χθες το πρωί πήγαμε στην αγορά για να αγοράσουμε φρέσκα λαχανικά και ψάρια για το τραπέζι της Κυριακής. Ο ήλιος έλαμπε και οι δρόμοι ήταν γεμάτοι κόσμο που μιλούσε και γελούσε. Η γιαγιά μας είπε ότι παλιά όλοι γνωρίζονταν μεταξύ τους και ότι τα παιδιά έπαιζαν στην πλατεία μέχρι το βράδυ.",
    "ar": "ذهبنا صباح أمس إلى السوق القديم لشراء الخضار والفواكه الطازجة، وكان المكان مزدحما بالناس الذين جاؤوا من القرى المجاورة. تحدثنا مع البائع عن أحوال الطقس وعن الأمطار التي تأخرت هذا العام، ثم جلسنا في مقهى صغير وشربنا الشاي بالنعناع. وفي المساء عدنا إلى البيت ونحن نحمل الكثير من الأكياس.",
    "he": "אתמול בבוקר הלכנו לשוק כדי לקנות ירקות ופירות טריים לארוחת השבת. השמש זרחה והרחובות היו מלאים באנשים שדיברו וצחקו. סבתא סיפרה לנו שפעם כולם הכירו את כולם, ושהילדים היו משחקים בכיכר עד שעות הערב המאוחרות. בדרך הביתה עצרנו ליד הספרייה החדשה ושאלנו שני ספרים.",
    "hi": "कल सुबह हम लोग ताज़ी सब्ज़ियाँ और फल खरीदने के लिए पुराने बाज़ार गए थे। वहाँ बहुत भीड़ थी, लेकिन सभी लोग खुश दिख रहे थे क्योंकि बारिश के बाद मौसम ठंडा हो गया था। दुकानदार ने हमें बताया कि इस साल आम की फसल बहुत अच्छी हुई है। शाम को हम सब ने मिलकर खाना बनाया और पुरानी कहानियाँ सुनीं।",
    "zh": "昨天早上我们去市场买新鲜的蔬菜和水果。街上人很多，大家都在谈论最近的天气。卖菜的老人告诉我们，今年的雨水比往年多，所以西瓜不太甜。中午我们在河边的小饭馆吃了面条，然后沿着公园慢慢走回家。晚上全家人坐在一起喝茶，听爷爷讲他年轻时候的故事，大家都觉得非常开心。",
    "ja": "昨日の朝、私たちは新鮮な野菜と果物を買うために市場へ行きました。通りには多くの人がいて、みんな最近の天気について話していました。店の人は、今年は雨が多かったので、すいかがあまり甘くないと教えてくれました。お昼には川のそばの小さな食堂でうどんを食べて、それから公園を歩いて家に帰りました。",
    "ko": "어제 아침에 우리는 신선한 채소와 과일을 사러 시장에 갔습니다. 거리에는 사람들이 많았고 모두 요즘 날씨에 대해 이야기하고 있었습니다. 가게 주인은 올해 비가 많이 와서 수박이 별로 달지 않다고 말해 주었습니다. 점심에는 강가의 작은 식당에서 국수를 먹고 공원을 지나 천천히 집으로 걸어왔습니다.",
    "th": "เมื่อวานตอนเช้าเราไปตลาดเพื่อซื้อผักและผลไม้สดสำหรับทำอาหารเย็นของครอบครัว ผู้คนเดินกันเต็มถนนและพูดคุยเรื่องอากาศที่เปลี่ยนแปลงบ่อยในช่วงนี้ คนขายบอกว่าปีนี้ฝนตกมากทำให้แตงโมไม่ค่อยหวาน ตอนเย็นเรานั่งกินข้าวด้วยกันและฟังคุณปู่เล่าเรื่องสมัยที่ท่านยังเป็นเด็ก",
}
