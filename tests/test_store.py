import pytest

from quillon.sources.store import ConcurrencyError, Store, StoreError


@pytest.fixture
def store(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/db", create=True)
    s.execute(
        "CREATE TABLE `Customers` (`Id` counter(1,1) NOT NULL, `Name` varchar(40) NOT NULL DEFAULT 'none', `Since` datetime, CONSTRAINT `PK` PRIMARY KEY (`Id`));"
        "CREATE TABLE `Orders` (`Id` integer PRIMARY KEY, `CustomerId` integer, `Total` decimal(10,2), CONSTRAINT `FK` FOREIGN KEY (`CustomerId`) REFERENCES `Customers` (`Id`) ON DELETE CASCADE, CONSTRAINT `CK` CHECK (`Total` >= 0))"
    )
    s.execute("INSERT INTO `Customers` (`Name`) VALUES ('a;b'); INSERT INTO `Customers` (`Name`, `Since`) VALUES ('it''s', #2024-01-02 03:04:05#)")
    s.insert("Orders", [{"Id": 1, "CustomerId": 1, "Total": None}, {"Id": 2, "CustomerId": 2, "Total": None}, {"Id": 3, "CustomerId": None, "Total": None}])
    return s


def names(s):
    return sorted((r.Id, r.Name) for r in s.table("Customers").collect())


def test_insert_reads_back_identity_and_rowcount(store):
    assert names(store) == [(1, "a;b"), (2, "it's")]
    store.execute("INSERT INTO `Customers` (`Since`) VALUES (NULL)")
    assert store.execute("SELECT @@identity").first()[0] == 3 and store.execute("SELECT @@ROWCOUNT").first()[0] == 1 and names(store)[2] == (3, "none")
    assert store.execute("INSERT INTO `Customers` (`Name`) SELECT `Name` FROM `Customers` WHERE `Id` > 1") == 2 and store.identity == 5


def test_update_and_delete(store):
    assert store.execute("UPDATE `Customers` SET `Name` = `Name` & '!' WHERE `Id` = 2") == 1 and names(store)[1] == (2, "it's!")
    assert store.execute("UPDATE `Orders` INNER JOIN `Customers` ON `Orders`.`CustomerId` = `Customers`.`Id` SET `Total` = `Customers`.`Id` * 10 WHERE `Customers`.`Name` LIKE 'it%'") == 1
    assert {r.Id: r.Total and float(r.Total) for r in store.table("Orders").collect()} == {1: None, 2: 20.0, 3: None}
    assert store.execute("DELETE FROM `Customers` WHERE EXISTS (SELECT 1 FROM `Orders` AS `o` WHERE `o`.`CustomerId` = `Customers`.`Id` AND `o`.`Total` IS NULL)") == 1
    assert names(store) == [(2, "it's!")]
    assert sorted(r.Id for r in store.table("Orders").collect()) == [2, 3]
    assert store.delete("Customers", "Id = 2") == 1 and [r.Id for r in store.table("Orders").collect()] == [3]


def test_concurrency_check(store):
    with pytest.raises(ConcurrencyError):
        store.update("Customers", {"Name": "'x'"}, "Id = 99", expect=1)
    with pytest.raises(ConcurrencyError):
        store.delete("Customers", "Id < 99", expect=1)
    assert len(names(store)) == 2


def test_constraints(store):
    for bad in ("INSERT INTO `Orders` (`Id`, `CustomerId`) VALUES (9, 77)", "INSERT INTO `Orders` (`Id`, `CustomerId`) VALUES (1, 1)", "INSERT INTO `Orders` (`Id`, `Total`) VALUES (9, -1)", "UPDATE `Customers` SET `Name` = NULL", "DROP TABLE `Customers`"):
        with pytest.raises(StoreError):
            store.execute(bad)
    assert store.table("Orders").count() == 3


def test_definitions(store):
    store.execute("ALTER TABLE `Customers` ADD COLUMN `Age` integer; ALTER TABLE `Customers` ALTER COLUMN `Age` integer NOT NULL DEFAULT 7")
    assert [r.Age for r in store.table("Customers").collect()] == [7, 7]
    store.execute("RENAME COLUMN `Customers`.`Age` TO `Years`; CREATE UNIQUE INDEX `IX` ON `Customers` (`Name`); RENAME TABLE `Orders` TO `Sales`")
    assert store.tables() == ["Customers", "Sales"] and "Years" in store.table("Customers").columns and store.table("Sales").count() == 3
    store.rename_index("Customers", "IX", "IX2")
    store.execute("DROP INDEX `IX2` ON `Customers`; ALTER TABLE `Customers` DROP COLUMN `Years`; ALTER TABLE `Sales` DROP CONSTRAINT `FK`; DROP TABLE `Customers`")
    assert store.tables() == ["Sales"] and store.model()["Sales"].names == ["Id", "CustomerId", "Total"]


def test_conditions_and_procedures(store):
    store.execute("IF EXISTS (SELECT * FROM `INFORMATION_SCHEMA.TABLES` WHERE `TABLE_NAME` = 'Orders') THEN DROP TABLE `Orders`; IF NOT EXISTS (SELECT * FROM `INFORMATION_SCHEMA.TABLES` WHERE `TABLE_NAME` = 'Orders') THEN CREATE TABLE `New` (`x` integer)")
    assert store.tables() == ["Customers", "New"]
    store.procedures["ByName"] = "SELECT `Id` FROM `Customers` WHERE `Name` = ?"
    assert [r.Id for r in store.execute("EXEC `ByName` @n", {"n": "it's"}).collect()] == [2]


def test_catalog_views(store):
    view = lambda name: [tuple(r) for r in store.query(f"SELECT * FROM `INFORMATION_SCHEMA.{name}`").collect()]
    assert [r[0] for r in view("TABLES")] == ["Customers", "Orders"] and ("Customers", "Id", 0, "counter(1,1)", False, None, None, None, None, 1, 1) in view("COLUMNS")
    assert ("Customers", "PrimaryKey", "PRIMARY", True) in view("INDEXES") and ("Customers", "PrimaryKey", 0, "Id") in view("INDEX_COLUMNS")
    assert view("RELATIONS") == [("FK", "Orders", "Customers", "CASCADE")] and view("RELATION_COLUMNS") == [("FK", "CustomerId", "Id", 0)] and view("CHECK_CONSTRAINTS") == [("Orders", "CK", "`Total` >= 0")]


def test_migrations_run_once(store):
    steps = [("one", lambda s: s.create_table("M", {"x": "integer"})), ("two", lambda s: s.add_column("M", "y", "integer"))]
    assert store.migrate(steps) == ["one", "two"] and store.migrate(steps) == []
    assert Store(store.spark, store.root).table("M").columns == ["x", "y"]
    store.drop()
    with pytest.raises(StoreError):
        Store(store.spark, store.root)


def test_cascades_reach_every_depth_and_set_null(store):
    store.execute("CREATE TABLE `Staff` (`Id` integer PRIMARY KEY, `Boss` integer)")
    store.insert("Staff", [{"Id": 1, "Boss": None}, {"Id": 2, "Boss": 1}, {"Id": 3, "Boss": 2}, {"Id": 4, "Boss": None}])
    store.execute("CREATE TABLE `Desk` (`Id` integer PRIMARY KEY, `Owner` integer, CONSTRAINT `FD` FOREIGN KEY (`Owner`) REFERENCES `Staff` (`Id`) ON DELETE SET NULL)")
    store.insert("Desk", [{"Id": 1, "Owner": 3}, {"Id": 2, "Owner": 4}])
    store.add_foreign_key("FB", "Staff", ["Boss"], "Staff", ["Id"], "CASCADE")
    assert store.execute("DELETE FROM `Staff` WHERE `Id` = 1") == 1
    assert [r.Id for r in store.table("Staff").collect()] == [4] and sorted((r.Id, r.Owner) for r in store.table("Desk").collect()) == [(1, None), (2, 4)]


def test_a_referenced_key_cannot_change_or_go(store):
    store.execute("ALTER TABLE `Orders` DROP CONSTRAINT `FK`; ALTER TABLE `Orders` ADD CONSTRAINT `FK2` FOREIGN KEY (`CustomerId`) REFERENCES `Customers` (`Id`)")
    for bad in ("UPDATE `Customers` SET `Id` = 11 WHERE `Id` = 1", "DELETE FROM `Customers` WHERE `Id` IN (SELECT `CustomerId` FROM `Orders`)"):
        with pytest.raises(StoreError):
            store.execute(bad)
    assert names(store) == [(1, "a;b"), (2, "it's")]


def test_update_over_several_joins_and_delete_over_a_page(store):
    store.execute("CREATE TABLE `Rates` (`Name` varchar(40), `Id` integer, `Rate` integer)")
    store.insert("Rates", [{"Name": "a;b", "Id": 1, "Rate": 3}, {"Name": "it's", "Id": 1, "Rate": 5}])
    assert store.execute("UPDATE `Orders` AS `o` INNER JOIN `Customers` AS `c` ON `o`.`CustomerId` = `c`.`Id` LEFT JOIN `Rates` AS `r` ON `r`.`Name` = `c`.`Name` AND `r`.`Id` = `c`.`Id` SET `o`.`Total` = `r`.`Rate` * 2") == 2
    assert {r.Id: r.Total and float(r.Total) for r in store.table("Orders").collect()} == {1: 6.0, 2: None, 3: None}
    assert store.execute("DELETE FROM `Orders` WHERE `Id` IN (SELECT `x`.`Id` FROM (SELECT TOP 2 `Id` FROM `Orders` ORDER BY `Id` DESC) AS `x`)") == 2
    assert [r.Id for r in store.table("Orders").collect()] == [1]


def test_inserts_append_and_number_in_order(store):
    rows = store.spark.range(1000).selectExpr("concat('n', lpad(id, 4, '0')) as Name").repartition(7)
    assert store.insert("Customers", rows) == 1000 and store.identity == 1002
    got = sorted((r.Id, r.Name) for r in store.table("Customers").collect())[2:]
    assert got == [(i + 3, f"n{i:04d}") for i in range(1000)]
    assert len(store._state()["tables"]["Customers"]["parts"]) == 3


def test_databases_and_scaffold(store, tmp_path):
    from quillon.plans.statements import database

    made = database(store.spark, f"CREATE DATABASE 'file://{tmp_path}/other'")
    assert made.tables() == []
    database(store.spark, f"DROP DATABASE 'file://{tmp_path}/other'")
    assert not made.exists()
    model = store.scaffold()
    assert model["Orders"]["primary_key"] == ["Id"] and model["Orders"]["references"] == {"FK": "Customers"} and model["Customers"]["collections"] == {"FK": "Orders"}
    assert [c["nullable"] for c in model["Customers"]["columns"]] == [False, False, True] and model["Orders"]["foreign_keys"]["FK"]["on_delete"] == "CASCADE"
