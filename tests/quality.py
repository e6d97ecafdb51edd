"""A small corpus and questions to it, for holding retrieval quality to figures: 8 documents, 25 questions they answer, 8 they don't."""

DOCUMENTS = {
    "arilar.md": """# Arı yetiştiriciliği

Kovanlar ilkbaharda güneye bakan, rüzgâr almayan yamaçlara yerleştirilir. Bir kovanda tek bir ana arı bulunur ve günde iki bine yakın yumurta bırakır.

## Bal hasadı

Bal hasadı temmuz sonunda yapılır. Sırlanmamış petekler hasat edilmez, çünkü nemi yüksek bal ekşir. Süzme makinesi petekleri döndürerek balı ayırır.

## Hastalıklar

Varroa akarı kovanların en yaygın zararlısıdır. Akarla mücadelede oksalik asit kışın, yavru yokken uygulanır.
""",
    "bisiklet.md": """# Bisiklet bakımı

Zincir her üç yüz kilometrede bir temizlenir ve yağlanır. Kuru havada mumlu yağ, yağmurda ise kalın yağ kullanılır.

## Lastik basıncı

Yol bisikletlerinde lastik basıncı altı ile sekiz bar arasındadır. Dağ bisikletlerinde iki bar yeterlidir; düşük basınç tutuşu artırır.

## Fren ayarı

Disk frenlerde balata kalınlığı bir milimetrenin altına inince balatalar değiştirilir. Hidrolik hortumda hava kalırsa fren kolu boşalır.
""",
    "deprem.md": """# Deprem çantası

Çantada kişi başına dört litre su, konserve, düdük, fener ve yedek pil bulunur. Çanta kapıya yakın bir dolapta saklanır ve altı ayda bir yenilenir.

## Sarsıntı anında

Sarsıntı sırasında masanın altına girilir, baş korunur ve masanın ayağına tutunulur. Asansör kullanılmaz, merdivene koşulmaz.

## Toplanma alanı

Mahallenin toplanma alanı ilkokulun arkasındaki futbol sahasıdır. Gaz vanası binadan çıkmadan önce kapatılır.
""",
    "kutuphane.md": """# Kütüphane kuralları

Üyeler aynı anda beş kitap ödünç alabilir. Ödünç süresi on beş gündür ve bir kez uzatılabilir.

## Gecikme

Geciken her kitap için günlük iki lira ceza alınır. Kaybolan kitabın bedeli güncel satış fiyatı üzerinden ödenir.

## Çalışma odaları

Grup çalışma odaları en fazla altı kişiliktir ve internet sitesinden ayırtılır. Kütüphane pazartesi günleri kapalıdır.
""",
    "ekmek.md": """# Ekşi mayalı ekmek

Maya, un ve su eşit ağırlıkta karıştırılarak beş günde hazırlanır. Her gün yarısı atılır ve taze unla beslenir.

## Hamur

Bir kilo un için yedi yüz gram su, iki yüz gram maya ve yirmi gram tuz gerekir. Hamur dört saat boyunca her yarım saatte bir katlanır.

## Pişirme

Ekmek döküm tencerede iki yüz otuz derecede, önce kapaklı sonra kapaksız pişirilir. Buhar kabuğun çıtır olmasını sağlar.
""",
    "fotograf.md": """# Gece fotoğrafı

Yıldızları çekmek için diyafram sonuna kadar açılır ve ISO değeri üç bine çıkarılır. Pozlama süresi yirmi saniyeyi geçerse yıldızlar çizgiye dönüşür.

## Üçayak

Üçayak rüzgârda titremesin diye orta direğine ağırlık asılır. Titreşimi önlemek için uzaktan kumanda kullanılır.

## Ay ışığı

Dolunayda gökyüzü parlaktır, bu yüzden samanyolu yeni ayda çekilir. Pil soğukta çabuk biter; yedeği cepte taşınır.
""",
    "zeytin.md": """# Zeytin ağacı

Zeytin fidanları altı metre aralıkla dikilir. Ağaç ilk meyvesini dördüncü yılda verir ve yüzlerce yıl yaşar.

## Budama

Budama şubat ayında, don tehlikesi geçince yapılır. Ağacın ortası ışık alacak biçimde kase gibi açılır.

## Zeytinyağı

Sızma zeytinyağı yirmi yedi derecenin altında, soğuk sıkımla elde edilir. Asitlik oranı yüzde birin altındadır. Yağ, ışık geçirmeyen teneke kutularda saklanır.
""",
    "satranc.md": """# Satranç kulübü

Kulüp her çarşamba akşamı belediye binasının ikinci katında toplanır. Aidat ayda elli liradır, öğrencilerden aidat alınmaz.

## Turnuva

Bahar turnuvası yedi tur İsviçre sistemiyle oynanır. Düşünme süresi oyuncu başına altmış dakikadır, her hamlede otuz saniye eklenir.

## Puanlama

Yeni oyuncuların başlangıç puanı bin ikiyüzdür. Beraberlik yarım puan getirir.
""",
}

QUESTIONS = [
    ("Bir kovanda kaç ana arı bulunur?", "arilar.md"), ("Bal hasadı ne zaman yapılır?", "arilar.md"), ("Varroa akarına karşı oksalik asit ne zaman uygulanır?", "arilar.md"), ("Sırlanmamış petekler neden hasat edilmez?", "arilar.md"),
    ("Zincir kaç kilometrede bir yağlanır?", "bisiklet.md"), ("Yol bisikletinde lastik basıncı kaç bar olmalı?", "bisiklet.md"), ("Disk fren balataları ne zaman değiştirilir?", "bisiklet.md"),
    ("Deprem çantasında kişi başına kaç litre su bulunur?", "deprem.md"), ("Sarsıntı sırasında ne yapılır?", "deprem.md"), ("Mahallenin toplanma alanı neresidir?", "deprem.md"),
    ("Üyeler kaç kitap ödünç alabilir?", "kutuphane.md"), ("Geciken kitap için ne kadar ceza alınır?", "kutuphane.md"), ("Grup çalışma odaları kaç kişiliktir?", "kutuphane.md"), ("Kütüphane hangi günleri kapalıdır?", "kutuphane.md"),
    ("Bir kilo un için kaç gram tuz gerekir?", "ekmek.md"), ("Hamur kaç saat boyunca katlanır?", "ekmek.md"), ("Ekmek kaç derecede pişirilir?", "ekmek.md"),
    ("Yıldızları çekmek için ISO değeri kaç olmalı?", "fotograf.md"), ("Üçayak rüzgârda titremesin diye ne yapılır?", "fotograf.md"), ("Samanyolu neden yeni ayda çekilir?", "fotograf.md"),
    ("Zeytin fidanları kaç metre aralıkla dikilir?", "zeytin.md"), ("Budama hangi ayda yapılır?", "zeytin.md"), ("Sızma zeytinyağı kaç derecenin altında elde edilir?", "zeytin.md"),
    ("Satranç kulübü hangi akşam toplanır?", "satranc.md"), ("Turnuvada düşünme süresi kaç dakikadır?", "satranc.md"),
    ("Uçak bileti nasıl iptal edilir?", None), ("Dolar kuru bugün kaç?", None), ("Köpeğim neden havlıyor?", None), ("Python ile dosya nasıl okunur?", None),
    ("Marsın uyduları hangileridir?", None), ("Grip aşısı yan etkileri nelerdir?", None), ("Vergi beyannamesi nereye verilir?", None), ("Gitar akordu nasıl değişir?", None),
]
