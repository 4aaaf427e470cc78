"""Seed prose in eleven languages, written for this package, and seed code. Training material of the models."""

from __future__ import annotations

PROSE: dict[str, str] = {
    "en": """
This function returns the number of items that are still waiting in the queue. If the connection is closed before the answer arrives, the request is sent again after a short delay.
The user must not change the value while the service is running, because other parts of the system depend on it. We keep a copy of every message so that nothing gets lost when the server stops.
Please make sure that all of the settings have been loaded before you start the program. Each of these methods can be called more than once without any harm. There is no need to lock the file when only one process is writing to it.
It was decided that the old names should be kept for at least two years, even though they are not used by the new interface. Most people will never see this warning. What happens when they do is described below.
She opened the door and looked at the letters on the table. The children were playing outside, and nobody had told them about the storm that was coming from the north. He could not remember who had given him the book.
Creates a new object and adds it to the list unless it already exists. Removes everything that has not been used since the last update. Checks whether both sides have the same version. Reads the first line from the input, then waits for more.
The documentation of this component is generated automatically, and every comment has to be completed by its author. Default implementation of the interface; subclasses may provide a different configuration. Describe the operation, its arguments and the condition under which an exception is thrown.
Please do not modify this section, since all changes will be overwritten by the next release. Licensed under the terms of the agreement, without any warranty. Copyright of the contributors, all rights reserved. Adds a description of the method to the given class.
the of and to in is that it for was on are as with his they at be this have from or one had by word but not what all were we when your can said there use an each which she do how their if will up other about out many then them these so some her would make like him into time has look two more write go see number no way could people my than first been call who its now find long down day did get come made may part
""",
    "de": """
Diese Funktion gibt die Anzahl der Elemente zurück, die noch in der Warteschlange stehen. Wenn die Verbindung geschlossen wird, bevor die Antwort eintrifft, wird die Anfrage nach einer kurzen Pause noch einmal gesendet.
Der Benutzer darf den Wert nicht ändern, während der Dienst läuft, weil andere Teile des Systems davon abhängen. Wir behalten eine Kopie jeder Nachricht, damit nichts verloren geht, wenn der Server anhält.
Bitte stellen Sie sicher, dass alle Einstellungen geladen wurden, bevor Sie das Programm starten. Jede dieser Methoden kann mehrmals aufgerufen werden, ohne dass ein Schaden entsteht. Es ist nicht nötig, die Datei zu sperren, wenn nur ein Prozess hineinschreibt.
Man hat beschlossen, dass die alten Namen mindestens zwei Jahre lang erhalten bleiben, obwohl sie von der neuen Schnittstelle nicht mehr benutzt werden. Die meisten Leute werden diese Warnung nie sehen. Was dann geschieht, wird unten beschrieben.
Sie öffnete die Tür und sah die Briefe auf dem Tisch. Die Kinder spielten draußen, und niemand hatte ihnen von dem Sturm erzählt, der aus dem Norden kam. Er konnte sich nicht erinnern, wer ihm das Buch gegeben hatte.
Erzeugt ein neues Objekt und fügt es der Liste hinzu, falls es noch nicht vorhanden ist. Entfernt alles, was seit der letzten Aktualisierung nicht verwendet wurde. Prüft, ob beide Seiten dieselbe Version haben. Liest die erste Zeile der Eingabe und wartet auf weitere.
Der Abgleich durchsucht alle Verzeichnisse, überträgt fehlende Einträge und übergeht veraltete Stände. Ein übergeordneter Schlüssel sperrt jeden Zweig, bis die Prüfung abgeschlossen ist; danach läuft der Vergleich von der Wurzel zu den Blättern weiter. Jüngere Fassungen überschreiben ältere, sofern beide gültig sind.
Während der Überprüfung bleiben übernommene Änderungen sichtbar. Das Gerät schreibt Zwischenstände in ein Protokoll, durchläuft sämtliche Knoten des Baumes und vergleicht ihre Prüfsummen. Fällt das Netz aus, verwirft der Empfänger unvollständige Blöcke und beginnt später von vorn.
der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde sei gegen vom können schon wenn habe seine ihre dann unter wir soll ich eines jahr zwei diese dieser wieder keine uhr seiner worden will zwischen immer was sagte gibt alle seit muss doch jetzt waren drei mir damit bereits auch ob weil
""",
    "fr": """
Cette fonction renvoie le nombre d'éléments qui attendent encore dans la file. Si la connexion est fermée avant que la réponse n'arrive, la demande est envoyée de nouveau après un court délai.
L'utilisateur ne doit pas changer la valeur pendant que le service fonctionne, parce que d'autres parties du système en dépendent. Nous gardons une copie de chaque message pour que rien ne soit perdu lorsque le serveur s'arrête.
Veuillez vous assurer que tous les réglages ont été chargés avant de lancer le programme. Chacune de ces méthodes peut être appelée plusieurs fois sans danger. Il n'est pas nécessaire de verrouiller le fichier quand un seul processus y écrit.
On a décidé que les anciens noms seraient conservés pendant au moins deux ans, bien qu'ils ne soient plus utilisés par la nouvelle interface. La plupart des gens ne verront jamais cet avertissement. Ce qui se passe alors est décrit ci-dessous.
Elle ouvrit la porte et regarda les lettres posées sur la table. Les enfants jouaient dehors, et personne ne leur avait parlé de la tempête qui venait du nord. Il ne se souvenait plus de celui qui lui avait donné le livre.
Crée un nouvel objet et l'ajoute à la liste sauf s'il existe déjà. Retire tout ce qui n'a pas servi depuis la dernière mise à jour. Vérifie que les deux côtés ont la même version. Lit la première ligne de l'entrée, puis attend la suite.
La configuration par défaut reste valable tant que la vérification des signatures n'a pas échoué. Les versions précédentes refusent toute demande invalide; sans autorisation explicite, une opération est rejetée et les informations restent masquées. Le gestionnaire accepte une extension, valide la structure puis applique la modification demandée.
Chaque requête possède une durée maximale, une priorité et une destination; la fonction de comparaison ignore les différences de ponctuation. Sans réponse du service distant, la tâche refuse de continuer et signale une exception. Les notifications sont transmises dans l'ordre de création, même si une ancienne copie existe encore quelque part.
de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont la mais comme ou si leur y dont aux avec cette ces ses été être ont elle nous vous fait son sa même aussi entre bien peut tous après sans deux où tout ils encore autre depuis avant très sous donc contre jusque chez lors quand faire cela toute aucun chaque lorsque puis afin ainsi car moins
""",
    "es": """
Esta función devuelve el número de elementos que todavía esperan en la cola. Si la conexión se cierra antes de que llegue la respuesta, la petición se envía otra vez después de una breve pausa.
El usuario no debe cambiar el valor mientras el servicio está en marcha, porque otras partes del sistema dependen de él. Guardamos una copia de cada mensaje para que no se pierda nada cuando el servidor se detiene.
Asegúrese de que todos los ajustes se han cargado antes de iniciar el programa. Cada uno de estos métodos puede llamarse más de una vez sin ningún daño. No hace falta bloquear el archivo cuando solo un proceso escribe en él.
Se decidió que los nombres antiguos se mantendrían durante al menos dos años, aunque la nueva interfaz ya no los usa. La mayoría de la gente no verá nunca este aviso. Lo que ocurre entonces se describe más abajo.
Ella abrió la puerta y miró las cartas que había sobre la mesa. Los niños jugaban fuera, y nadie les había hablado de la tormenta que venía del norte. No podía recordar quién le había dado el libro.
Crea un objeto nuevo y lo añade a la lista si todavía no existe. Quita todo lo que no se ha usado desde la última actualización. Comprueba si ambos lados tienen la misma versión. Lee la primera línea de la entrada y después espera más.
El programa espera hasta que el campo esté completo y solo después muestra el resultado más reciente al usuario. El archivo del agente queda en la carpeta del proyecto y la respuesta del servidor llega más tarde. Ninguno de los campos es obligatorio, pero el nombre del cliente y la fecha del pedido no pueden quedar vacíos. La clase no quita el bloqueo, solo mira si la rama sigue abierta.
de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si sin sobre este ya entre cuando todo esta ser son dos también fue había era muy años hasta desde está mi porque qué sólo han yo hay vez puede todos así nos ni parte tiene él uno donde bien tiempo mismo ese ahora cada e vida otro después te otros aunque esa eso hace otra gobierno tan durante siempre día tanto ella tres sí dijo sido gran país según menos mientras nadie
""",
    "it": """
Questa funzione restituisce il numero degli elementi che aspettano ancora nella coda. Se la connessione viene chiusa prima che arrivi la risposta, la richiesta viene inviata di nuovo dopo una breve pausa.
L'utente non deve cambiare il valore mentre il servizio è in esecuzione, perché altre parti del sistema ne dipendono. Teniamo una copia di ogni messaggio affinché nulla vada perduto quando il server si ferma.
Assicurarsi che tutte le impostazioni siano state caricate prima di avviare il programma. Ciascuno di questi metodi può essere chiamato più di una volta senza alcun danno. Non occorre bloccare il file quando un solo processo ci scrive.
Si è deciso che i vecchi nomi rimangano per almeno due anni, anche se la nuova interfaccia non li usa più. La maggior parte della gente non vedrà mai questo avviso. Quello che succede allora è descritto qui sotto.
Lei aprì la porta e guardò le lettere sul tavolo. I bambini giocavano fuori e nessuno aveva parlato loro della tempesta che arrivava dal nord. Non riusciva a ricordare chi gli avesse dato il libro.
Crea un nuovo oggetto e lo aggiunge alla lista se non esiste già. Toglie tutto ciò che non è stato usato dopo l'ultimo aggiornamento. Verifica che le due parti abbiano la stessa versione. Legge la prima riga dell'ingresso e poi ne attende altre.
Il programma aspetta che il campo sia compilato e soltanto dopo mostra il risultato più recente all'utente. L'archivio dell'agente resta nella cartella del progetto e la risposta del server arriva più tardi. Nessuno dei campi è obbligatorio, ma il nome del cliente e la data dell'ordine non possono restare vuoti. La classe non toglie il blocco, controlla soltanto se il ramo è ancora aperto.
di e il la che in a per un è non una sono da del con si le al dei come della più i ma lo gli alla ha o anche nel delle se ad stato due dal questa suo essere hanno nella era ed su loro ai solo tra dopo ci molto sua questo quando prima fatto ancora dalla cui tutti quello tutto fra stata dove già sulla ogni perché ora senza fino contro così mentre degli alle poi sempre qui può chi anni parte però nessuno ciò agli oppure proprio cosa
""",
    "pt": """
Esta função devolve o número de elementos que ainda esperam na fila. Se a ligação for fechada antes que a resposta chegue, o pedido é enviado outra vez depois de uma pequena pausa.
O utilizador não deve mudar o valor enquanto o serviço estiver a funcionar, porque outras partes do sistema dependem dele. Guardamos uma cópia de cada mensagem para que nada se perca quando o servidor para.
Certifique-se de que todas as configurações foram carregadas antes de iniciar o programa. Cada um destes métodos pode ser chamado mais de uma vez sem nenhum dano. Não é preciso bloquear o arquivo quando apenas um processo escreve nele.
Foi decidido que os nomes antigos seriam mantidos por pelo menos dois anos, embora já não sejam usados pela nova interface. A maioria das pessoas nunca verá este aviso. O que acontece então está descrito abaixo.
Ela abriu a porta e olhou para as cartas em cima da mesa. As crianças brincavam lá fora, e ninguém lhes tinha falado da tempestade que vinha do norte. Ele não conseguia lembrar quem lhe tinha dado o livro.
Cria um novo objeto e o acrescenta à lista se ainda não existir. Retira tudo o que não foi usado desde a última atualização. Verifica se os dois lados têm a mesma versão. Lê a primeira linha da entrada e depois espera por mais.
O programa aguarda até que o campo seja preenchido e só então mostra o resultado mais recente ao utilizador. O arquivo do agente fica guardado na pasta do projeto, e a resposta do servidor chega mais tarde. Nenhum dos campos é obrigatório, mas o nome do cliente e a data do pedido não podem ficar vazios. A classe não remove o bloqueio, apenas verifica se o ramo ainda está aberto.
O texto do aviso, o tempo de espera e o tamanho do bloco são lidos do ficheiro; o resto fica como está. Mais de metade do tempo foi gasto do lado do cliente, o que é muito.
de a o que e do da em um para é com não uma os no se na por mais as dos como mas foi ao ele das tem à seu sua ou ser quando muito há nos já está eu também só pelo pela até isso ela entre era depois sem mesmo aos ter seus quem nas me esse eles estão você tinha foram essa num nem suas meu às minha têm numa pelos elas havia seja qual será nós tenho lhe deles essas esses pelas este fosse dele então porque enquanto ninguém ainda outro cada
""",
    "nl": """
Deze functie geeft het aantal elementen terug die nog in de wachtrij staan. Als de verbinding wordt gesloten voordat het antwoord binnenkomt, wordt het verzoek na een korte pauze opnieuw verstuurd.
De gebruiker mag de waarde niet veranderen terwijl de dienst draait, omdat andere delen van het systeem ervan afhangen. Wij bewaren een kopie van elk bericht zodat er niets verloren gaat wanneer de server stopt.
Zorg ervoor dat alle instellingen geladen zijn voordat u het programma start. Elk van deze methoden kan meer dan één keer worden aangeroepen zonder dat het kwaad kan. Het is niet nodig om het bestand te vergrendelen wanneer maar één proces erin schrijft.
Er is besloten dat de oude namen minstens twee jaar behouden blijven, hoewel ze door de nieuwe interface niet meer gebruikt worden. De meeste mensen zullen deze waarschuwing nooit zien. Wat er dan gebeurt, wordt hieronder beschreven.
Zij opende de deur en keek naar de brieven op de tafel. De kinderen speelden buiten en niemand had hun verteld over de storm die uit het noorden kwam. Hij kon zich niet herinneren wie hem het boek had gegeven.
Maakt een nieuw object en voegt het toe aan de lijst tenzij het al bestaat. Verwijdert alles wat sinds de laatste wijziging niet is gebruikt. Controleert of beide kanten dezelfde versie hebben. Leest de eerste regel van de invoer en wacht daarna op meer.
de van het een en in is dat op te zijn met voor niet aan er om ook als dan maar die bij door naar uit wordt nog over kan worden tot hij geen ze heeft dit zo zal was wel moet meer hebben al of werd deze zich onder hun veel tegen jaar nu zou twee haar wat men hem tussen eerste andere toch omdat mijn zonder waar na alle zelf ik je tijd alleen goed weer hoe nieuwe zeer daar iemand wanneer elke zodat tijdens
""",
    "pl": """
Ta funkcja zwraca liczbę elementów, które nadal czekają w kolejce. Jeśli połączenie zostanie zamknięte, zanim nadejdzie odpowiedź, żądanie jest wysyłane ponownie po krótkiej przerwie.
Użytkownik nie powinien zmieniać wartości, kiedy usługa działa, ponieważ zależą od niej inne części systemu. Przechowujemy kopię każdej wiadomości, żeby nic nie zginęło, gdy serwer się zatrzyma.
Proszę się upewnić, że wszystkie ustawienia zostały wczytane przed uruchomieniem programu. Każdą z tych metod można wywołać więcej niż jeden raz bez żadnej szkody. Nie trzeba blokować pliku, jeżeli zapisuje do niego tylko jeden proces.
Postanowiono, że stare nazwy pozostaną przez co najmniej dwa lata, chociaż nowy interfejs już ich nie używa. Większość ludzi nigdy nie zobaczy tego ostrzeżenia. To, co się wtedy dzieje, opisano poniżej.
Otworzyła drzwi i spojrzała na listy leżące na stole. Dzieci bawiły się na dworze i nikt im nie powiedział o burzy, która nadchodziła z północy. Nie mógł sobie przypomnieć, kto dał mu tę książkę.
Tworzy nowy obiekt i dodaje go do listy, o ile jeszcze nie istnieje. Usuwa wszystko, czego nie używano od ostatniej zmiany. Sprawdza, czy obie strony mają tę samą wersję. Czyta pierwszy wiersz wejścia, a potem czeka na dalsze.
w i na z się nie do to że o jest jak po co za od przez ale dla czy już tylko jego tak był ma ze oraz są być może jej także które który lub tym ich pod było będzie sie jako przed przy gdy bardzo ten została można nad też mu tej jeszcze kiedy została jednak więc aby bez tego która między dwa każdy we jeżeli wszystkie inne nawet dopóki podczas gdzie nic
""",
    "ru": """
Эта функция возвращает число элементов, которые ещё стоят в очереди. Если соединение закроется до того, как придёт ответ, запрос будет отправлен снова после небольшой паузы.
Пользователь не должен менять значение, пока служба работает, потому что от него зависят другие части системы. Мы храним копию каждого сообщения, чтобы ничего не потерялось, когда сервер остановится.
Убедитесь, что все настройки загружены, прежде чем запускать программу. Каждый из этих методов можно вызывать несколько раз без всякого вреда. Не нужно блокировать файл, когда в него пишет только один процесс.
Решено, что старые имена сохранятся по крайней мере два года, хотя новый интерфейс их больше не использует. Большинство людей никогда не увидит этого предупреждения. Что тогда происходит, описано ниже.
Она открыла дверь и посмотрела на письма, лежавшие на столе. Дети играли во дворе, и никто не рассказал им о буре, которая шла с севера. Он не мог вспомнить, кто дал ему книгу.
Создаёт новый объект и добавляет его в список, если его там ещё нет. Убирает всё, что не использовалось после последнего обновления. Проверяет, одинаковы ли версии с обеих сторон.
и в не на я быть он с что а по это она этот к но они мы весь который из у который то за свой что весь год от так о для ты же все тот мочь вы человек такой его сказать только или ещё бы себя один как уже до время если сам когда другой вот говорить наш мой знать стать при чтобы дело жизнь кто первый очень два день её новый рука даже во со раз где там под можно ну какой после их работа без самый потом надо хотеть ли слово идти большой должен место иметь ничто
""",
    "ja": """
この関数はまだ待ち行列に残っている要素の数を返します。応答が届く前に接続が閉じられた場合は、少し待ってから要求をもう一度送ります。
サービスが動いている間は、利用者はこの値を変更してはいけません。システムの他の部分がこの値に依存しているからです。サーバーが止まっても何も失われないように、すべてのメッセージの写しを保存しています。
プログラムを始める前に、すべての設定が読み込まれていることを確認してください。これらのメソッドは何度呼び出しても問題ありません。一つのプロセスだけが書き込む場合は、ファイルをロックする必要はありません。
古い名前は新しいインターフェースでは使われませんが、少なくとも二年間は残すことになりました。ほとんどの人はこの警告を見ることはないでしょう。その時に起こることは下に書いてあります。
彼女はドアを開けて、机の上の手紙を見ました。子供たちは外で遊んでいて、北から来る嵐のことを誰も話していませんでした。
新しいオブジェクトを作り、まだ存在しなければリストに追加します。最後の更新から使われていないものをすべて取り除きます。両側のバージョンが同じかどうかを調べます。データを更新して、結果をキャッシュに書きます。
""",
    "zh": """
这个函数返回仍在队列中等待的元素数量。如果在收到回答之前连接被关闭，请求会在短暂停顿之后重新发送。
服务运行期间用户不得更改这个值，因为系统的其他部分依赖它。我们保存每条消息的副本，以便服务器停止时不会丢失任何内容。
启动程序之前，请确认所有设置都已经加载。这些方法可以多次调用，不会造成任何损害。只有一个进程写入文件时，没有必要锁定文件。
虽然新的接口不再使用旧的名称，但决定至少保留两年。大多数人永远不会看到这个警告。那时会发生什么，请看下面的说明。
她打开门，看了看桌子上的信。孩子们在外面玩，没有人告诉他们从北方来的暴风雨。他想不起来是谁把这本书给了他。
创建一个新的对象，如果它还不存在，就把它添加到列表里。删除上次更新以后没有使用过的所有内容。检查两边的版本是否相同。读取输入的第一行，然后等待更多。这一步更新数据，并且把结果写进缓存。
""",
}

CODE = """
public class RecordIndex { private final Map<String, Long> counts = new HashMap<>(); public long get(String key) { return counts.getOrDefault(key, 0L); } }
for (int i = 0; i < values.size(); i++) { total += values.get(i).length(); if (total > 4096) { break; } }
int headPos = list.size() - 12; return headPos; log.info("cacheEntry {}", readBlock(40213, 'c', 0x3fa2b));
if (node != null) { node.release(ctx, 14); } return node; var left = tree.rotate(8812, "tree-0af3c"); map.put("9a31{", left.fold(55));
private fun loadIndex(file: String?, limit: Int): List<String> { val rows = store.scan(limit, "row-11fe0") return rows.map { it.name } }
pub fn merge_page(&self, left: &str, right: Option<u32>) -> Vec<String> { let page_count = self.pages.len_of(20391, "page-77ac1")?; if page.len() > 128 { self.drop_page(b"0f1e2"); } }
let value = try reader.next(limit: 512, tag: "reader-c01d9") guard value.count < 99 else { return flushAll("e0f13") }
const total = try self.pool.grow_slot(3381, "pool-9b0e1"); if (slot.len > 40) { self.free_slot(0x1a2b3); } @import("std"); pub const Slot = struct { };
SELECT user_id, name FROM accounts WHERE user_id > 100 AND state = 'open' ORDER BY name; INSERT INTO log_entries (id, note) VALUES (17, 'x'); CREATE TABLE page_index (row_id BIGINT PRIMARY KEY, title VARCHAR(80) NOT NULL);
{"count": 42, "items": ["a1f9", "77be"], "name": "x-19", "open": true} page_slot = [12, 7, 93] limit_rate: 0.75; key=value&sort=asc
https://host-name.example/v2/items/8fa31c?page=3 /usr/local/share/data/config.json ./src/main/resources org.example.store.PageIndex src/lib/util.rs
3f786850e387550fdab836ed7e6dc881de23001b 9f86d081884c7d659a2feaa0c55ad015 550e8400-e29b-41d4-a716-446655440000 0xdeadbeef 1.25.0-rc2 2024-05-01T10:00:00Z
@Override @param value @return @throws IOException @see PageIndex#get(String) @since 2.4 {@link PageStore} {@inheritDoc} <p> </p> <code>page_slot</code> &amp; ASC | DESC | PAGE_SLOT ---- ==== // /** */ /// #[derive(Debug)]
def load(path, limit=10): return [x for x in open(path) if len(x) > limit]  import os, sys  export PATH=/usr/bin:$PATH  $ make -j8 install
pageStore.openSlot(cursor, 9) ReadBlockHandler WriteAheadLog getOrDefault setPageCount page_count_max block_index_of x1 y2 tmp3 i j k fn fun func let var val return if else while for struct impl match
"""

#: Shorter seeds of further languages, told apart sentence by sentence only.
FURTHER: dict[str, str] = {
    "sv": """
Den här funktionen returnerar antalet element som fortfarande väntar i kön. Om anslutningen stängs innan svaret kommer skickas begäran igen efter en kort paus. Användaren får inte ändra värdet medan tjänsten körs, eftersom andra delar av systemet beror på det.
Vi behåller en kopia av varje meddelande så att ingenting går förlorat när servern stannar. Se till att alla inställningar har lästs in innan du startar programmet. Hon öppnade dörren och såg breven på bordet. Barnen lekte utanför och ingen hade berättat för dem om stormen.
Skapar ett nytt objekt och lägger till det i listan om det inte redan finns. Filen låses inte när bara en process skriver till den. Läser första raden och väntar sedan på mer.
och att det som en på är av för med den till inte om ett har de jag var men så från vi kan när han nu sig eller hur alla ska skulle mycket också bara under mot där efter någon något vara blir alltid innan mellan utan denna dessa
""",
    "da": """
Denne funktion returnerer antallet af elementer, der stadig venter i køen. Hvis forbindelsen lukkes, før svaret kommer, sendes anmodningen igen efter en kort pause. Brugeren må ikke ændre værdien, mens tjenesten kører, fordi andre dele af systemet afhænger af den.
Vi gemmer en kopi af hver besked, så intet går tabt, når serveren stopper. Sørg for, at alle indstillinger er blevet indlæst, før du starter programmet. Hun åbnede døren og så brevene på bordet. Børnene legede udenfor, og ingen havde fortalt dem om stormen.
Opretter et nyt objekt og føjer det til listen, hvis det ikke allerede findes. Filen bliver ikke låst, når kun én proces skriver i den. Læser den første linje og venter derefter på mere.
og at det er en til på som for med den af ikke der de har et jeg var han men fra vi kan når så sig eller hvor alle skal ville meget også kun under mod efter noget nogen være bliver altid før mellem uden denne disse hvad hvis
""",
    "fi": """
Tämä funktio palauttaa jonossa vielä odottavien alkioiden määrän. Jos yhteys suljetaan ennen kuin vastaus saapuu, pyyntö lähetetään uudelleen lyhyen tauon jälkeen. Käyttäjä ei saa muuttaa arvoa palvelun ollessa käynnissä, koska muut järjestelmän osat riippuvat siitä.
Säilytämme kopion jokaisesta viestistä, jotta mitään ei katoa palvelimen pysähtyessä. Varmista, että kaikki asetukset on ladattu ennen ohjelman käynnistämistä. Hän avasi oven ja katsoi pöydällä olevia kirjeitä. Lapset leikkivät ulkona eikä kukaan ollut kertonut heille myrskystä.
Luo uuden olion ja lisää sen luetteloon, jos sitä ei vielä ole. Tiedostoa ei lukita, kun vain yksi prosessi kirjoittaa siihen. Lukee ensimmäisen rivin ja odottaa sitten lisää.
ja on ei se että oli hän joka mutta kun niin myös tai sen ovat kuin voi mitä jos vain nyt hänen ole jo kaikki siitä sitä minun mukaan ennen jälkeen kanssa ilman aina vielä tämän tässä
""",
    "tr": """
Bu işlev kuyrukta hâlâ bekleyen öğelerin sayısını döndürür. Yanıt gelmeden önce bağlantı kapanırsa istek kısa bir aradan sonra yeniden gönderilir. Hizmet çalışırken kullanıcı bu değeri değiştirmemelidir, çünkü sistemin diğer bölümleri ona bağlıdır.
Sunucu durduğunda hiçbir şey kaybolmasın diye her iletinin bir kopyasını saklıyoruz. Programı başlatmadan önce bütün ayarların yüklendiğinden emin olun. Kapıyı açtı ve masanın üzerindeki mektuplara baktı. Çocuklar dışarıda oynuyordu ve kimse onlara fırtınadan söz etmemişti.
Yeni bir nesne oluşturur ve henüz yoksa listeye ekler. Yalnızca tek bir süreç yazıyorsa dosyayı kilitlemek gerekmez. İlk satırı okur, sonra devamını bekler.
ve bir bu da de için ile çok ne o daha gibi kadar olarak sonra ama var değil her en olan ya ki mi ben sen biz siz onlar şey önce bütün hiç nasıl neden çünkü ancak veya ise eğer yok olur oldu
""",
    "cs": """
Tato funkce vrací počet prvků, které ještě čekají ve frontě. Pokud se spojení uzavře dříve, než přijde odpověď, požadavek se po krátké přestávce odešle znovu. Uživatel nesmí měnit hodnotu, když služba běží, protože na ní závisí jiné části systému.
Uchováváme kopii každé zprávy, aby se nic neztratilo, když se server zastaví. Ujistěte se, že všechna nastavení byla načtena před spuštěním programu. Otevřela dveře a podívala se na dopisy na stole. Děti si hrály venku a nikdo jim neřekl o bouři.
Vytvoří nový objekt a přidá jej do seznamu, pokud ještě neexistuje. Soubor není třeba zamykat, pokud do něj zapisuje jen jeden proces. Přečte první řádek a potom čeká na další.
a se v na je že o s z do i to k ve pro za by ale si po jako byl jsou od nebo jeho tak který být bylo jen podle již než která jsem může až při když ještě před také mezi kde více však jejich není musí
""",
    "uk": """
Ця функція повертає кількість елементів, які ще чекають у черзі. Якщо з'єднання закриється до того, як надійде відповідь, запит буде надіслано знову після короткої паузи. Користувач не повинен змінювати значення, поки служба працює, бо від нього залежать інші частини системи.
Ми зберігаємо копію кожного повідомлення, щоб нічого не загубилося, коли сервер зупиниться. Переконайтеся, що всі налаштування завантажено, перш ніж запускати програму. Вона відчинила двері й подивилася на листи, що лежали на столі. Діти гралися надворі, і ніхто не розповів їм про бурю.
Створює новий об'єкт і додає його до списку, якщо його там ще немає. Не потрібно блокувати файл, якщо в нього пише лише один процес. Читає перший рядок, а потім чекає на решту.
і в не на що з та до як у це за від є його але вони який якщо для про був через лише ще або ми ви їх так вже коли після між без може щоб бути тому також під час цього всі
""",
    "ro": """
Această funcție întoarce numărul elementelor care încă așteaptă în coadă. Dacă legătura se închide înainte să sosească răspunsul, cererea este trimisă din nou după o scurtă pauză. Utilizatorul nu trebuie să schimbe valoarea cât timp serviciul rulează, pentru că alte părți ale sistemului depind de ea.
Păstrăm o copie a fiecărui mesaj ca să nu se piardă nimic atunci când serverul se oprește. Asigurați-vă că toate setările au fost încărcate înainte de a porni programul. Ea a deschis ușa și s-a uitat la scrisorile de pe masă. Copiii se jucau afară și nimeni nu le spusese despre furtună.
Creează un obiect nou și îl adaugă în listă dacă nu există deja. Nu este nevoie să blocați fișierul când un singur proces scrie în el. Citește primul rând și apoi așteaptă restul.
și de în a la cu nu pe care că o este să din se un mai pentru sunt fi ce au al fost dar sau ca după lui ei său prin dacă între fără această acest toate când doar foarte încă până
""",
    "hu": """
Ez a függvény visszaadja a sorban még várakozó elemek számát. Ha a kapcsolat a válasz megérkezése előtt bezárul, a kérést egy rövid szünet után újra elküldjük. A felhasználó nem változtathatja meg az értéket, amíg a szolgáltatás fut, mert a rendszer más részei függnek tőle.
Minden üzenetről megőrzünk egy másolatot, hogy semmi ne vesszen el, amikor a kiszolgáló leáll. Győződjön meg arról, hogy minden beállítás betöltődött, mielőtt elindítja a programot. Kinyitotta az ajtót, és megnézte az asztalon fekvő leveleket. A gyerekek kint játszottak, és senki sem beszélt nekik a viharról.
Létrehoz egy új objektumot, és hozzáadja a listához, ha még nem létezik. Nem kell zárolni a fájlt, ha csak egyetlen folyamat ír bele. Beolvassa az első sort, majd vár a folytatásra.
a az és hogy nem is egy meg ez van de csak mint már vagy volt ha még el ki be fel le azt ezt lehet kell így majd minden után között nélkül mert amikor ahol aki amely több első
""",
}
