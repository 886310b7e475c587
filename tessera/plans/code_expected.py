"""What the queries of code_catalog must give for one region, as literal rows."""

EXPECTED: dict[str, list[tuple]] = {
    "call_site_forms": [
        ("cpp/NN/a.cpp::EngineNN.runNN", 1, "n", False, "stepNN"),
        ("cpp/NN/a.cpp::EngineNN.stepNN#2", 1, "n", False, "freeNN"),
        ("cpp/NN/a.cpp::EngineNN.stepNN#2", 1, "n", False, "other"),
        ("cpp/NN/a.cpp::EngineNN.stepNN#2", 1, "n", False, "pump.pushNN"),
        ("cpp/NN/a.cpp::EngineNN.stepNN#2", 1, "n", False, "vec.pushNN"),
        ("cs/NN/App.cs::AppNN.RunNN", 0, "", False, "QueueNN"),
        ("cs/NN/App.cs::AppNN.RunNN", 1, "#int", False, "HelpNN"),
        ("cs/NN/App.cs::AppNN.RunNN", 1, "text", False, "ConvNN.ParseNN"),
        ("cs/NN/App.cs::AppNN.RunNN", 1, "text", False, "log.SaveNN"),
        ("cs/NN/App.cs::AppNN.RunNN", 1, "text", False, "q.PushNN"),
        ("cs/NN/App.cs::AppNN.RunNN", 1, "text", False, "store.SaveNN"),
        ("cs/NN/App.cs::AppNN.RunNN", 1, "text", True, "ConvNN.ParseNN"),
        ("cs/NN/Conv.cs::ConvNN.ParseNN#2", 1, "T", False, "default"),
        ("go/NN/main.go::Server.Serve", 1, "n", False, "NewWriter"),
        ("go/NN/main.go::Server.Serve", 1, "n", False, "cache.Get"),
        ("go/NN/main.go::Server.Serve", 1, "n", False, "json.Marshal"),
        ("go/NN/main.go::Server.Serve", 1, "n", False, "renderNN.New"),
        ("go/NN/main.go::Server.Serve", 1, "n", False, "s.log"),
        ("go/NN/main.go::Server.Serve", 1, "n", False, "w.Write"),
        ("java/NN/app/ServiceNN.java::ServiceNN.check", 0, "", False, "s.isEmpty"),
        ("java/NN/app/ServiceNN.java::ServiceNN.helper", 1, "s", False, "check"),
        ("java/NN/app/ServiceNN.java::ServiceNN.run", 0, "", False, "make"),
        ("java/NN/app/ServiceNN.java::ServiceNN.run", 1, "#int", False, "pick"),
        ("java/NN/app/ServiceNN.java::ServiceNN.run", 1, "id", False, "Logger.info"),
        ("java/NN/app/ServiceNN.java::ServiceNN.run", 1, "id", False, "helper"),
        ("java/NN/app/ServiceNN.java::ServiceNN.run", 1, "id", False, "make().save"),
        ("java/NN/app/ServiceNN.java::ServiceNN.run", 1, "id", False, "out.save"),
        ("java/NN/app/ServiceNN.java::ServiceNN.run", 1, "id", False, "repo.save"),
        ("java/NN/app/ServiceNN.java::ServiceNN.run", 1, "n", False, "TaskNN"),
        ("java/NN/app/ServiceNN.java::ServiceNN.run", 1, "n", False, "inherited"),
        ("php/NN/Shop.php::ShopNN.buyNN", 0, "", False, "$this.anyNN"),
        ("php/NN/Shop.php::ShopNN.buyNN", 0, "", False, "$this.makeNN"),
        ("php/NN/Shop.php::ShopNN.buyNN", 0, "", False, "WishNN"),
        ("php/NN/Shop.php::ShopNN.buyNN", 0, "", False, "anyNN().doneNN"),
        ("php/NN/Shop.php::ShopNN.buyNN", 0, "", False, "makeNN().checkoutNN"),
        ("php/NN/Shop.php::ShopNN.buyNN", 1, "#int", False, "$logger.addNN"),
        ("php/NN/Shop.php::ShopNN.buyNN", 1, "#int", False, "cart.addNN"),
        ("php/NN/Shop.php::ShopNN.makeNN", 0, "", False, "CartNN"),
        ("py/NN/app.py::AppNN.__init__", 0, "", False, "super"),
        ("py/NN/app.py::AppNN.__init__", 0, "", False, "super.__init__"),
        ("py/NN/app.py::AppNN.run", 0, "", False, "item.save"),
        ("py/NN/app.py::AppNN.run", 0, "", False, "self.kept"),
        ("py/NN/app.py::AppNN.run", 0, "", False, "self.step"),
        ("py/NN/app.py::AppNN.run", 1, "item", False, "json.save"),
        ("py/NN/app.py::AppNN.run", 1, "item", False, "store.save"),
        ("py/NN/app.py::AppNN.step", 1, "#int", False, "helper"),
        ("py/NN/app.py::helper", 0, "", False, "Store"),
        ("py/NN/broken.py::After.stays", 0, "", False, "good"),
        ("py/NN/broken.py::good", 1, "#int", False, "helper"),
        ("py/NN/test_app.py::aid", 1, "#int", False, "helper"),
        ("py/NN/test_app.py::test_helper", 1, "#int", False, "helper"),
        ("py/NN/test_app.py::test_via", 0, "", False, "aid"),
        ("rs/NN/core/src/main.rs::Job.drive", 0, "", False, "Job.new"),
        ("rs/NN/core/src/main.rs::Job.drive", 0, "", False, "new().finish"),
        ("rs/NN/core/src/main.rs::Job.drive", 1, "#int", False, "PathBuf.from"),
        ("rs/NN/core/src/main.rs::Job.drive", 1, "#int", False, "deep"),
        ("rs/NN/core/src/main.rs::Job.drive", 1, "#int", False, "hidden"),
        ("rs/NN/core/src/main.rs::Job.drive", 1, "#int", False, "parse.run"),
        ("rs/NN/core/src/main.rs::Job.drive", 1, "#int", False, "shown"),
        ("rs/NN/core/src/main.rs::Job.drive", 1, "self", False, "drop"),
        ("ts/NN/app.ts::AppNN.constructor", 0, "", False, "super"),
        ("ts/NN/app.ts::AppNN.start", 0, "", False, "Cache"),
        ("ts/NN/app.ts::AppNN.start", 0, "", False, "this.stop"),
        ("ts/NN/app.ts::AppNN.start", 1, "id", False, "axios.load"),
        ("ts/NN/app.ts::AppNN.start", 1, "id", False, "c.load"),
        ("ts/NN/app.ts::AppNN.start", 1, "id", False, "shared"),
        ("ts/NN/app.ts::AppNN.start", 1, "id", False, "store.load"),
        ("ts/NN/app.ts::shared", 1, "id", False, "lowest"),
    ],
    "calls_cpp": [
        ("cpp/NN/a.cpp::EngineNN.runNN", "cpp/NN/a.cpp::EngineNN.stepNN#2", 0.85, "regex", "regex-fallback"),
        ("cpp/NN/a.cpp::EngineNN.runNN", "cpp/NN/a.cpp::EngineNN.stepNN", 0.85, "regex", "regex-fallback"),
        ("cpp/NN/a.cpp::EngineNN.stepNN#2", "cpp/NN/a.cpp::freeNN", 0.85, "regex", "regex-fallback"),
        ("cpp/NN/a.cpp::EngineNN.stepNN#2", "cpp/NN/b.hpp::PumpNN.pushNN", 0.6, "regex", "regex-fallback"),
    ],
    "calls_cs": [
        ("cs/NN/App.cs::AppNN.RunNN", "cs/NN/App.cs::AppNN.HelpNN", 0.85, "regex", "regex-fallback"),
        ("cs/NN/App.cs::AppNN.RunNN", "cs/NN/Conv.cs::ConvNN.ParseNN#2", 0.6, "regex", "regex-fallback"),
        ("cs/NN/App.cs::AppNN.RunNN", "cs/NN/Conv.cs::ConvNN.ParseNN", 0.6, "regex", "regex-fallback"),
        ("cs/NN/App.cs::AppNN.RunNN", "cs/NN/Store.cs::QueueNN.PushNN", 0.6, "regex", "regex-fallback"),
        ("cs/NN/App.cs::AppNN.RunNN", "cs/NN/Store.cs::StoreNN.SaveNN", 0.6, "regex", "regex-fallback"),
    ],
    "calls_go": [
        ("go/NN/main.go::Server.Serve", "go/NN/cache.go::Cache.Get", 0.6, "regex", "regex-fallback"),
        ("go/NN/main.go::Server.Serve", "go/NN/cache.go::Writer.Write", 0.6, "regex", "regex-fallback"),
        ("go/NN/main.go::Server.Serve", "go/NN/main.go::NewWriter", 0.85, "regex", "regex-fallback"),
        ("go/NN/main.go::Server.Serve", "go/NN/main.go::Server.log", 0.85, "regex", "regex-fallback"),
        ("go/NN/main.go::Server.Serve", "go/NN/renderNN/render.go::New", 0.6, "regex", "regex-fallback"),
    ],
    "calls_java": [
        ("java/NN/app/ServiceNN.java::ServiceNN.helper", "java/NN/app/ServiceNN.java::ServiceNN.check", 0.85, "regex", "regex-fallback"),
        ("java/NN/app/ServiceNN.java::ServiceNN.run", "java/NN/app/BaseNN.java::BaseNN.inherited", 0.85, "heuristic", "inheritance"),
        ("java/NN/app/ServiceNN.java::ServiceNN.run", "java/NN/app/ServiceNN.java::ServiceNN.helper", 0.85, "regex", "regex-fallback"),
        ("java/NN/app/ServiceNN.java::ServiceNN.run", "java/NN/app/ServiceNN.java::ServiceNN.make", 0.85, "regex", "regex-fallback"),
        ("java/NN/app/ServiceNN.java::ServiceNN.run", "java/NN/app/ServiceNN.java::ServiceNN.pick#2", 0.85, "regex", "regex-fallback"),
        ("java/NN/app/ServiceNN.java::ServiceNN.run", "java/NN/app/TaskNN.java::TaskNN.TaskNN", 0.6, "regex", "regex-fallback"),
        ("java/NN/app/ServiceNN.java::ServiceNN.run", "java/NN/store/RepoNN.java::RepoNN.save", 0.6, "regex", "regex-fallback"),
    ],
    "calls_php": [
        ("php/NN/Shop.php::ShopNN.buyNN", "php/NN/Cart.php::CartNN.addNN", 0.6, "regex", "regex-fallback"),
        ("php/NN/Shop.php::ShopNN.buyNN", "php/NN/Cart.php::CartNN.checkoutNN", 0.6, "regex", "regex-fallback"),
        ("php/NN/Shop.php::ShopNN.buyNN", "php/NN/Shop.php::ShopNN.anyNN", 0.85, "regex", "regex-fallback"),
        ("php/NN/Shop.php::ShopNN.buyNN", "php/NN/Shop.php::ShopNN.makeNN", 0.85, "regex", "regex-fallback"),
        ("php/NN/Shop.php::ShopNN.buyNN", "php/NN/Wish.php::WishNN.__construct", 0.85, "heuristic", "constructor"),
    ],
    "calls_py": [
        ("py/NN/app.py::AppNN.__init__", "py/NN/store.py::BaseNN.__init__", 0.85, "heuristic", "inheritance"),
        ("py/NN/app.py::AppNN.run", "py/NN/app.py::AppNN.size", 0.7, "ast", "property"),
        ("py/NN/app.py::AppNN.run", "py/NN/app.py::AppNN.step", 0.95, "ast", "ast-narrowed"),
        ("py/NN/app.py::AppNN.run", "py/NN/store.py::BaseNN.kept", 0.85, "heuristic", "inheritance"),
        ("py/NN/app.py::AppNN.run", "py/NN/store.py::Store.save", 0.95, "ast", "ast-narrowed"),
        ("py/NN/app.py::AppNN.step", "py/NN/app.py::helper", 0.95, "ast", "ast-narrowed"),
        ("py/NN/app.py::helper", "py/NN/store.py::Store.__init__", 0.85, "heuristic", "constructor"),
        ("py/NN/broken.py::After.stays", "py/NN/broken.py::good", 0.95, "ast", "ast-narrowed"),
        ("py/NN/broken.py::good", "py/NN/app.py::helper", 0.95, "ast", "ast-narrowed"),
        ("py/NN/broken.py::typing_now", "py/NN/app.py::helper", 0.6, "regex", "regex-fallback"),
        ("py/NN/test_app.py::aid", "py/NN/app.py::helper", 0.95, "ast", "ast-narrowed"),
        ("py/NN/test_app.py::test_helper", "py/NN/app.py::helper", 0.95, "ast", "ast-narrowed"),
        ("py/NN/test_app.py::test_via", "py/NN/test_app.py::aid", 0.95, "ast", "ast-narrowed"),
    ],
    "calls_rs": [
        ("rs/NN/core/src/main.rs::Job.drive", "rs/NN/core/src/main.rs::Job.finish", 0.85, "regex", "regex-fallback"),
        ("rs/NN/core/src/main.rs::Job.drive", "rs/NN/core/src/main.rs::Job.new", 0.85, "regex", "regex-fallback"),
        ("rs/NN/core/src/main.rs::Job.drive", "rs/NN/core/src/parse.rs::run", 0.6, "regex", "regex-fallback"),
        ("rs/NN/core/src/main.rs::Job.drive", "rs/NN/facade_NN/src/lib.rs::deep", 0.6, "regex", "regex-fallback"),
        ("rs/NN/core/src/main.rs::Job.drive", "rs/NN/printer_NN/src/lib.rs::shown", 0.6, "regex", "regex-fallback"),
    ],
    "calls_ts": [
        ("ts/NN/app.ts::AppNN.constructor", "ts/NN/store.ts::BaseNN.constructor", 0.85, "heuristic", "constructor"),
        ("ts/NN/app.ts::AppNN.start", "ts/NN/app.ts::AppNN.stop", 0.85, "regex", "regex-fallback"),
        ("ts/NN/app.ts::AppNN.start", "ts/NN/app.ts::shared", 0.85, "regex", "regex-fallback"),
        ("ts/NN/app.ts::AppNN.start", "ts/NN/store.ts::Store.load", 0.6, "regex", "regex-fallback"),
        ("ts/NN/app.ts::shared", "ts/NN/app.ts::lowest", 0.85, "regex", "regex-fallback"),
    ],
    "contains_code": [
        ("cpp/NN/a.cpp::EngineNN", "cpp/NN/a.cpp::EngineNN.EngineNN"),
        ("cpp/NN/a.cpp::EngineNN", "cpp/NN/a.cpp::EngineNN.runNN"),
        ("cpp/NN/a.cpp::EngineNN", "cpp/NN/a.cpp::EngineNN.stepNN#2"),
        ("cpp/NN/a.cpp::EngineNN", "cpp/NN/a.cpp::EngineNN.stepNN"),
        ("cpp/NN/b.hpp::PumpNN", "cpp/NN/b.hpp::PumpNN.pushNN"),
        ("cpp/NN/b.hpp::TankNN", "cpp/NN/b.hpp::TankNN.pushNN"),
        ("cs/NN/App.cs::AppNN", "cs/NN/App.cs::AppNN.AppNN"),
        ("cs/NN/App.cs::AppNN", "cs/NN/App.cs::AppNN.HelpNN#2"),
        ("cs/NN/App.cs::AppNN", "cs/NN/App.cs::AppNN.HelpNN"),
        ("cs/NN/App.cs::AppNN", "cs/NN/App.cs::AppNN.RunNN"),
        ("cs/NN/Conv.cs::ConvNN", "cs/NN/Conv.cs::ConvNN.ParseNN#2"),
        ("cs/NN/Conv.cs::ConvNN", "cs/NN/Conv.cs::ConvNN.ParseNN"),
        ("cs/NN/Store.cs::QueueNN", "cs/NN/Store.cs::QueueNN.PushNN"),
        ("cs/NN/Store.cs::QueueNN", "cs/NN/Store.cs::QueueNN.SaveNN"),
        ("cs/NN/Store.cs::StoreNN", "cs/NN/Store.cs::StoreNN.SaveNN"),
        ("go/NN/cache.go::Cache", "go/NN/cache.go::Cache.Get"),
        ("go/NN/cache.go::Cache", "go/NN/cache.go::Cache.Write"),
        ("go/NN/cache.go::Writer", "go/NN/cache.go::Writer.Write"),
        ("go/NN/d/impl10.go::Impl10", "go/NN/d/impl10.go::Impl10.ShutNN"),
        ("go/NN/d/impl11.go::Impl11", "go/NN/d/impl11.go::Impl11.ShutNN"),
        ("go/NN/d/impl12.go::Impl12", "go/NN/d/impl12.go::Impl12.ShutNN"),
        ("go/NN/d/impl13.go::Impl13", "go/NN/d/impl13.go::Impl13.ShutNN"),
        ("go/NN/d/impl14.go::Impl14", "go/NN/d/impl14.go::Impl14.ShutNN"),
        ("go/NN/d/impl15.go::Impl15", "go/NN/d/impl15.go::Impl15.ShutNN"),
        ("go/NN/d/impl16.go::Impl16", "go/NN/d/impl16.go::Impl16.ShutNN"),
        ("go/NN/d/impl17.go::Impl17", "go/NN/d/impl17.go::Impl17.ShutNN"),
        ("go/NN/d/impl18.go::Impl18", "go/NN/d/impl18.go::Impl18.ShutNN"),
        ("go/NN/d/impl19.go::Impl19", "go/NN/d/impl19.go::Impl19.ShutNN"),
        ("go/NN/d/impl20.go::Impl20", "go/NN/d/impl20.go::Impl20.ShutNN"),
        ("go/NN/d/impl21.go::Impl21", "go/NN/d/impl21.go::Impl21.ShutNN"),
        ("go/NN/d/impl22.go::Impl22", "go/NN/d/impl22.go::Impl22.ShutNN"),
        ("go/NN/d/impl23.go::Impl23", "go/NN/d/impl23.go::Impl23.ShutNN"),
        ("go/NN/d/impl24.go::Impl24", "go/NN/d/impl24.go::Impl24.ShutNN"),
        ("go/NN/d/impl25.go::Impl25", "go/NN/d/impl25.go::Impl25.ShutNN"),
        ("go/NN/d/impl26.go::Impl26", "go/NN/d/impl26.go::Impl26.ShutNN"),
        ("go/NN/d/impl27.go::Impl27", "go/NN/d/impl27.go::Impl27.ShutNN"),
        ("go/NN/main.go::Server", "go/NN/main.go::Server.Serve"),
        ("go/NN/main.go::Server", "go/NN/main.go::Server.log"),
        ("java/NN/app/BaseNN.java::BaseNN", "java/NN/app/BaseNN.java::BaseNN.inherited"),
        ("java/NN/app/ServiceNN.java::ServiceNN", "java/NN/app/ServiceNN.java::ServiceNN.check"),
        ("java/NN/app/ServiceNN.java::ServiceNN", "java/NN/app/ServiceNN.java::ServiceNN.helper"),
        ("java/NN/app/ServiceNN.java::ServiceNN", "java/NN/app/ServiceNN.java::ServiceNN.make"),
        ("java/NN/app/ServiceNN.java::ServiceNN", "java/NN/app/ServiceNN.java::ServiceNN.pick#2"),
        ("java/NN/app/ServiceNN.java::ServiceNN", "java/NN/app/ServiceNN.java::ServiceNN.pick"),
        ("java/NN/app/ServiceNN.java::ServiceNN", "java/NN/app/ServiceNN.java::ServiceNN.repo"),
        ("java/NN/app/ServiceNN.java::ServiceNN", "java/NN/app/ServiceNN.java::ServiceNN.run"),
        ("java/NN/app/TaskNN.java::TaskNN", "java/NN/app/TaskNN.java::TaskNN.TaskNN"),
        ("java/NN/app/TaskNN.java::TaskNN", "java/NN/app/TaskNN.java::TaskNN.info"),
        ("java/NN/store/CacheNN.java::CacheNN", "java/NN/store/CacheNN.java::CacheNN.save"),
        ("java/NN/store/RepoNN.java::RepoNN", "java/NN/store/RepoNN.java::RepoNN.save"),
        ("php/NN/Cart.php::CartNN", "php/NN/Cart.php::CartNN.addNN"),
        ("php/NN/Cart.php::CartNN", "php/NN/Cart.php::CartNN.checkoutNN"),
        ("php/NN/Cart.php::CartNN", "php/NN/Cart.php::CartNN.doneNN"),
        ("php/NN/Shop.php::ShopNN", "php/NN/Shop.php::ShopNN.__construct"),
        ("php/NN/Shop.php::ShopNN", "php/NN/Shop.php::ShopNN.anyNN"),
        ("php/NN/Shop.php::ShopNN", "php/NN/Shop.php::ShopNN.buyNN"),
        ("php/NN/Shop.php::ShopNN", "php/NN/Shop.php::ShopNN.makeNN"),
        ("php/NN/Wish.php::WishNN", "php/NN/Wish.php::WishNN.__construct"),
        ("php/NN/Wish.php::WishNN", "php/NN/Wish.php::WishNN.addNN"),
        ("php/NN/Wish.php::WishNN", "php/NN/Wish.php::WishNN.checkoutNN"),
        ("php/NN/Wish.php::WishNN", "php/NN/Wish.php::WishNN.doneNN"),
        ("py/NN/app.py::AppNN", "py/NN/app.py::AppNN.__init__"),
        ("py/NN/app.py::AppNN", "py/NN/app.py::AppNN.run"),
        ("py/NN/app.py::AppNN", "py/NN/app.py::AppNN.size"),
        ("py/NN/app.py::AppNN", "py/NN/app.py::AppNN.step"),
        ("py/NN/broken.py::After", "py/NN/broken.py::After.stays"),
        ("py/NN/store.py::BaseNN", "py/NN/store.py::BaseNN.__init__"),
        ("py/NN/store.py::BaseNN", "py/NN/store.py::BaseNN.kept"),
        ("py/NN/store.py::Store", "py/NN/store.py::Store.__init__"),
        ("py/NN/store.py::Store", "py/NN/store.py::Store.save"),
        ("rs/NN/core/src/main.rs::Job", "rs/NN/core/src/main.rs::Job.drive"),
        ("rs/NN/core/src/main.rs::Job", "rs/NN/core/src/main.rs::Job.finish"),
        ("rs/NN/core/src/main.rs::Job", "rs/NN/core/src/main.rs::Job.new"),
        ("rs/NN/core/src/main.rs::Sink", "rs/NN/core/src/main.rs::Sink.finish"),
        ("ts/NN/app.ts::AppNN", "ts/NN/app.ts::AppNN.constructor"),
        ("ts/NN/app.ts::AppNN", "ts/NN/app.ts::AppNN.start"),
        ("ts/NN/app.ts::AppNN", "ts/NN/app.ts::AppNN.stop"),
        ("ts/NN/cache.ts::Cache", "ts/NN/cache.ts::Cache.load"),
        ("ts/NN/store.ts::BaseNN", "ts/NN/store.ts::BaseNN.constructor"),
        ("ts/NN/store.ts::Store", "ts/NN/store.ts::Store.load"),
    ],
    "decorator_supplement": [
        ("py/NN/app.py::traced", "py/NN/app.py::AppNN.run", 0.7, "decorator"),
    ],
    "dispatch_rescue": [
        ("go/NN/d/iface.go::Blind", "go/NN/d/impl10.go::Impl10.ShutNN", 0.7, "heuristic", "dispatch"),
        ("go/NN/d/iface.go::Blind", "go/NN/d/impl11.go::Impl11.ShutNN", 0.7, "heuristic", "dispatch"),
        ("go/NN/d/iface.go::Blind", "go/NN/d/impl12.go::Impl12.ShutNN", 0.7, "heuristic", "dispatch"),
        ("go/NN/d/iface.go::Blind", "go/NN/d/impl13.go::Impl13.ShutNN", 0.7, "heuristic", "dispatch"),
        ("go/NN/d/iface.go::Blind", "go/NN/d/impl14.go::Impl14.ShutNN", 0.7, "heuristic", "dispatch"),
        ("go/NN/d/iface.go::Blind", "go/NN/d/impl15.go::Impl15.ShutNN", 0.7, "heuristic", "dispatch"),
        ("go/NN/d/iface.go::Blind", "go/NN/d/impl16.go::Impl16.ShutNN", 0.7, "heuristic", "dispatch"),
        ("go/NN/d/iface.go::Blind", "go/NN/d/impl17.go::Impl17.ShutNN", 0.7, "heuristic", "dispatch"),
        ("go/NN/d/iface.go::Blind", "go/NN/d/impl18.go::Impl18.ShutNN", 0.7, "heuristic", "dispatch"),
        ("go/NN/d/iface.go::Blind", "go/NN/d/impl19.go::Impl19.ShutNN", 0.7, "heuristic", "dispatch"),
        ("go/NN/d/iface.go::Blind", "go/NN/d/impl20.go::Impl20.ShutNN", 0.7, "heuristic", "dispatch"),
        ("go/NN/d/iface.go::Blind", "go/NN/d/impl21.go::Impl21.ShutNN", 0.7, "heuristic", "dispatch"),
        ("go/NN/d/iface.go::Blind", "go/NN/d/impl22.go::Impl22.ShutNN", 0.7, "heuristic", "dispatch"),
        ("go/NN/d/iface.go::Blind", "go/NN/d/impl23.go::Impl23.ShutNN", 0.7, "heuristic", "dispatch"),
        ("go/NN/d/iface.go::Blind", "go/NN/d/impl24.go::Impl24.ShutNN", 0.7, "heuristic", "dispatch"),
        ("go/NN/d/iface.go::Blind", "go/NN/d/impl25.go::Impl25.ShutNN", 0.7, "heuristic", "dispatch"),
        ("go/NN/d/iface.go::Blind", "go/NN/d/impl26.go::Impl26.ShutNN", 0.7, "heuristic", "dispatch"),
        ("go/NN/d/iface.go::Blind", "go/NN/d/impl27.go::Impl27.ShutNN", 0.7, "heuristic", "dispatch"),
        ("go/NN/d/iface.go::Drive", "go/NN/d/impl10.go::Impl10.ShutNN", 0.7, "heuristic", "dispatch"),
        ("go/NN/d/iface.go::Drive", "go/NN/d/impl11.go::Impl11.ShutNN", 0.7, "heuristic", "dispatch"),
        ("go/NN/d/iface.go::Drive", "go/NN/d/impl12.go::Impl12.ShutNN", 0.7, "heuristic", "dispatch"),
        ("go/NN/d/iface.go::Drive", "go/NN/d/impl13.go::Impl13.ShutNN", 0.7, "heuristic", "dispatch"),
        ("go/NN/d/iface.go::Drive", "go/NN/d/impl14.go::Impl14.ShutNN", 0.7, "heuristic", "dispatch"),
        ("go/NN/d/iface.go::Drive", "go/NN/d/impl15.go::Impl15.ShutNN", 0.7, "heuristic", "dispatch"),
        ("go/NN/d/iface.go::Drive", "go/NN/d/impl16.go::Impl16.ShutNN", 0.7, "heuristic", "dispatch"),
        ("go/NN/d/iface.go::Drive", "go/NN/d/impl17.go::Impl17.ShutNN", 0.7, "heuristic", "dispatch"),
        ("go/NN/d/iface.go::Drive", "go/NN/d/impl18.go::Impl18.ShutNN", 0.7, "heuristic", "dispatch"),
        ("go/NN/d/iface.go::Drive", "go/NN/d/impl19.go::Impl19.ShutNN", 0.7, "heuristic", "dispatch"),
        ("go/NN/d/iface.go::Drive", "go/NN/d/impl20.go::Impl20.ShutNN", 0.7, "heuristic", "dispatch"),
        ("go/NN/d/iface.go::Drive", "go/NN/d/impl21.go::Impl21.ShutNN", 0.7, "heuristic", "dispatch"),
        ("go/NN/d/iface.go::Drive", "go/NN/d/impl22.go::Impl22.ShutNN", 0.7, "heuristic", "dispatch"),
        ("go/NN/d/iface.go::Drive", "go/NN/d/impl23.go::Impl23.ShutNN", 0.7, "heuristic", "dispatch"),
        ("go/NN/d/iface.go::Drive", "go/NN/d/impl24.go::Impl24.ShutNN", 0.7, "heuristic", "dispatch"),
        ("go/NN/d/iface.go::Drive", "go/NN/d/impl25.go::Impl25.ShutNN", 0.7, "heuristic", "dispatch"),
        ("go/NN/d/iface.go::Drive", "go/NN/d/impl26.go::Impl26.ShutNN", 0.7, "heuristic", "dispatch"),
        ("go/NN/d/iface.go::Drive", "go/NN/d/impl27.go::Impl27.ShutNN", 0.7, "heuristic", "dispatch"),
    ],
    "extends_regex": [
        ("java/NN/app/ServiceNN.java::ServiceNN", "java/NN/app/BaseNN.java::BaseNN", "extends", 0.85),
        ("java/NN/app/ServiceNN.java::ServiceNN", "py/NN/store.py::BaseNN", "extends", 0.85),
        ("java/NN/app/ServiceNN.java::ServiceNN", "ts/NN/store.ts::BaseNN", "extends", 0.85),
        ("py/NN/app.py::AppNN", "java/NN/app/BaseNN.java::BaseNN", "extends", 0.85),
        ("py/NN/app.py::AppNN", "py/NN/store.py::BaseNN", "extends", 0.85),
        ("py/NN/app.py::AppNN", "ts/NN/store.ts::BaseNN", "extends", 0.85),
        ("ts/NN/app.ts::AppNN", "java/NN/app/BaseNN.java::BaseNN", "extends", 0.85),
        ("ts/NN/app.ts::AppNN", "py/NN/store.py::BaseNN", "extends", 0.85),
        ("ts/NN/app.ts::AppNN", "ts/NN/store.ts::BaseNN", "extends", 0.85),
    ],
    "extract_cpp": [
        ("class", "cpp/NN/a.cpp::EngineNN", 2, 9, False),
        ("constructor", "cpp/NN/a.cpp::EngineNN.EngineNN", 4, 4, False),
        ("function", "cpp/NN/a.cpp::freeNN", 16, 16, False),
        ("method", "cpp/NN/a.cpp::EngineNN.runNN", 5, 5, False),
        ("method", "cpp/NN/a.cpp::EngineNN.stepNN#2", 10, 15, False),
        ("method", "cpp/NN/a.cpp::EngineNN.stepNN", 6, 6, False),
        ("method", "cpp/NN/b.hpp::PumpNN.pushNN", 2, 2, False),
        ("method", "cpp/NN/b.hpp::TankNN.pushNN", 5, 5, False),
        ("struct", "cpp/NN/b.hpp::PumpNN", 1, 3, False),
        ("struct", "cpp/NN/b.hpp::TankNN", 4, 6, False),
    ],
    "extract_cs": [
        ("class", "cs/NN/App.cs::AppNN", 3, 18, False),
        ("class", "cs/NN/Conv.cs::ConvNN", 1, 4, False),
        ("class", "cs/NN/Store.cs::QueueNN", 4, 7, False),
        ("class", "cs/NN/Store.cs::StoreNN", 1, 3, False),
        ("constructor", "cs/NN/App.cs::AppNN.AppNN", 5, 5, False),
        ("method", "cs/NN/App.cs::AppNN.HelpNN#2", 17, 17, False),
        ("method", "cs/NN/App.cs::AppNN.HelpNN", 16, 16, False),
        ("method", "cs/NN/App.cs::AppNN.RunNN", 6, 15, False),
        ("method", "cs/NN/Conv.cs::ConvNN.ParseNN#2", 3, 3, False),
        ("method", "cs/NN/Conv.cs::ConvNN.ParseNN", 2, 2, False),
        ("method", "cs/NN/Store.cs::QueueNN.PushNN", 6, 6, False),
        ("method", "cs/NN/Store.cs::QueueNN.SaveNN", 5, 5, False),
        ("method", "cs/NN/Store.cs::StoreNN.SaveNN", 2, 2, False),
        ("namespace", "cs/NN/App.cs::NN", 2, 19, False),
    ],
    "extract_go": [
        ("const", "go/NN/main.go::Limit", 9, 9, True),
        ("const", "go/NN/main.go::second", 10, 10, False),
        ("function", "go/NN/main.go::NewWriter", 29, 29, True),
        ("function", "go/NN/renderNN/render.go::Marshal", 5, 5, True),
        ("function", "go/NN/renderNN/render.go::New", 3, 3, True),
        ("method", "go/NN/cache.go::Cache.Get", 5, 5, True),
        ("method", "go/NN/cache.go::Cache.Write", 11, 11, True),
        ("method", "go/NN/cache.go::Writer.Write", 9, 9, True),
        ("method", "go/NN/main.go::Server.Serve", 17, 25, True),
        ("method", "go/NN/main.go::Server.log", 27, 27, False),
        ("struct", "go/NN/cache.go::Cache", 3, 3, True),
        ("struct", "go/NN/cache.go::Writer", 7, 7, True),
        ("struct", "go/NN/main.go::Server", 13, 15, True),
    ],
    "extract_java": [
        ("class", "java/NN/app/BaseNN.java::BaseNN", 2, 4, True),
        ("class", "java/NN/app/ServiceNN.java::ServiceNN", 4, 23, True),
        ("class", "java/NN/app/TaskNN.java::TaskNN", 2, 5, False),
        ("class", "java/NN/store/CacheNN.java::CacheNN", 2, 4, True),
        ("class", "java/NN/store/RepoNN.java::RepoNN", 2, 4, True),
        ("constructor", "java/NN/app/TaskNN.java::TaskNN.TaskNN", 3, 3, False),
        ("field", "java/NN/app/ServiceNN.java::ServiceNN.repo", 5, 5, False),
        ("method", "java/NN/app/BaseNN.java::BaseNN.inherited", 3, 3, False),
        ("method", "java/NN/app/ServiceNN.java::ServiceNN.check", 20, 22, False),
        ("method", "java/NN/app/ServiceNN.java::ServiceNN.helper", 16, 16, False),
        ("method", "java/NN/app/ServiceNN.java::ServiceNN.make", 17, 17, False),
        ("method", "java/NN/app/ServiceNN.java::ServiceNN.pick#2", 19, 19, False),
        ("method", "java/NN/app/ServiceNN.java::ServiceNN.pick", 18, 18, False),
        ("method", "java/NN/app/ServiceNN.java::ServiceNN.run", 6, 15, True),
        ("method", "java/NN/app/TaskNN.java::TaskNN.info", 4, 4, True),
        ("method", "java/NN/store/CacheNN.java::CacheNN.save", 3, 3, True),
        ("method", "java/NN/store/RepoNN.java::RepoNN.save", 3, 3, True),
    ],
    "extract_php": [
        ("class", "php/NN/Cart.php::CartNN", 2, 6, False),
        ("class", "php/NN/Shop.php::ShopNN", 2, 13, False),
        ("class", "php/NN/Wish.php::WishNN", 2, 7, False),
        ("constructor", "php/NN/Shop.php::ShopNN.__construct", 3, 3, False),
        ("constructor", "php/NN/Wish.php::WishNN.__construct", 3, 3, False),
        ("method", "php/NN/Cart.php::CartNN.addNN", 4, 4, False),
        ("method", "php/NN/Cart.php::CartNN.checkoutNN", 3, 3, False),
        ("method", "php/NN/Cart.php::CartNN.doneNN", 5, 5, False),
        ("method", "php/NN/Shop.php::ShopNN.anyNN", 12, 12, False),
        ("method", "php/NN/Shop.php::ShopNN.buyNN", 4, 10, False),
        ("method", "php/NN/Shop.php::ShopNN.makeNN", 11, 11, False),
        ("method", "php/NN/Wish.php::WishNN.addNN", 5, 5, False),
        ("method", "php/NN/Wish.php::WishNN.checkoutNN", 4, 4, False),
        ("method", "php/NN/Wish.php::WishNN.doneNN", 6, 6, False),
    ],
    "extract_py": [
        ("class", "py/NN/app.py::AppNN", 9, 29, True),
        ("class", "py/NN/broken.py::After", 13, 15, True),
        ("class", "py/NN/store.py::BaseNN", 9, 14, True),
        ("class", "py/NN/store.py::Store", 1, 6, True),
        ("constructor", "py/NN/app.py::AppNN.__init__", 12, 13, False),
        ("constructor", "py/NN/store.py::BaseNN.__init__", 10, 11, False),
        ("constructor", "py/NN/store.py::Store.__init__", 2, 3, False),
        ("function", "py/NN/app.py::helper", 32, 33, True),
        ("function", "py/NN/app.py::traced", 5, 6, True),
        ("function", "py/NN/broken.py::good", 4, 5, True),
        ("function", "py/NN/broken.py::typing_now", 8, 10, True),
        ("function", "py/NN/test_app.py::aid", 8, 9, True),
        ("function", "py/NN/test_app.py::test_helper", 4, 5, True),
        ("function", "py/NN/test_app.py::test_via", 12, 13, True),
        ("method", "py/NN/app.py::AppNN.run", 16, 22, True),
        ("method", "py/NN/app.py::AppNN.size", 28, 29, True),
        ("method", "py/NN/app.py::AppNN.step", 24, 25, True),
        ("method", "py/NN/broken.py::After.stays", 14, 15, True),
        ("method", "py/NN/store.py::BaseNN.kept", 13, 14, True),
        ("method", "py/NN/store.py::Store.save", 5, 6, True),
    ],
    "extract_rs": [
        ("constructor", "rs/NN/core/src/main.rs::Job.new", 7, 7, True),
        ("function", "rs/NN/core/src/main.rs::from", 23, 23, False),
        ("function", "rs/NN/core/src/other.rs::drop", 2, 2, True),
        ("function", "rs/NN/core/src/other.rs::run", 1, 1, True),
        ("function", "rs/NN/core/src/parse.rs::run", 1, 1, True),
        ("function", "rs/NN/facade_NN/src/lib.rs::deep", 1, 1, True),
        ("function", "rs/NN/printer_NN/src/lib.rs::shown", 3, 3, True),
        ("function", "rs/NN/private_NN/src/lib.rs::hidden", 1, 1, True),
        ("method", "rs/NN/core/src/main.rs::Job.drive", 8, 16, True),
        ("method", "rs/NN/core/src/main.rs::Job.finish", 17, 17, False),
        ("method", "rs/NN/core/src/main.rs::Sink.finish", 21, 21, False),
        ("module", "rs/NN/core/src/main.rs::parse", 2, 2, False),
        ("struct", "rs/NN/core/src/main.rs::Job", 3, 5, True),
        ("struct", "rs/NN/core/src/main.rs::Sink", 19, 19, True),
    ],
    "extract_ts": [
        ("class", "ts/NN/app.ts::AppNN", 3, 14, True),
        ("class", "ts/NN/cache.ts::Cache", 1, 3, True),
        ("class", "ts/NN/store.ts::BaseNN", 5, 7, True),
        ("class", "ts/NN/store.ts::Store", 2, 4, True),
        ("constructor", "ts/NN/app.ts::AppNN.constructor", 4, 4, False),
        ("constructor", "ts/NN/store.ts::BaseNN.constructor", 6, 6, False),
        ("function", "ts/NN/app.ts::lowest", 16, 16, False),
        ("function", "ts/NN/app.ts::shared", 15, 15, True),
        ("method", "ts/NN/app.ts::AppNN.start", 5, 12, False),
        ("method", "ts/NN/app.ts::AppNN.stop", 13, 13, False),
        ("method", "ts/NN/cache.ts::Cache.load", 2, 2, False),
        ("method", "ts/NN/store.ts::Store.load", 3, 3, False),
    ],
    "import_edges": [
        ("file:cpp/NN/a.cpp", "import:b.hpp", "imports", 0.9),
        ("file:cs/NN/App.cs", "import:NN.Conv", "imports", 0.9),
        ("file:go/NN/main.go", "import:encoding/json", "imports", 0.9),
        ("file:go/NN/main.go", "import:example.com/NN/go/NN/renderNN", "imports", 0.9),
        ("file:java/NN/app/ServiceNN.java", "import:org.slf4j.Logger", "imports", 0.9),
        ("file:java/NN/app/ServiceNN.java", "import:storeNN.RepoNN", "imports", 0.9),
        ("file:py/NN/app.py", "import:.store", "imports", 0.9),
        ("file:py/NN/app.py", "import:json", "imports", 0.9),
        ("file:py/NN/broken.py", "import:.app", "imports", 0.9),
        ("file:py/NN/test_app.py", "import:.app", "imports", 0.9),
        ("file:rs/NN/core/src/main.rs", "import:printer_NN::out", "imports", 0.9),
        ("file:rs/NN/printer_NN/src/lib.rs", "import:private_NN::hidden", "imports", 0.9),
        ("file:rs/NN/printer_NN/src/lib.rs", "import:pub use facade_NN::deep", "imports", 0.9),
        ("file:ts/NN/app.ts", "import:./store", "imports", 0.9),
        ("file:ts/NN/app.ts", "import:axios", "imports", 0.9),
        ("file:ts/NN/store.ts", "import:./cache", "imports", 0.9),
    ],
    "interface_satisfaction": [
        ("go/NN/d/impl10.go::Impl10", "go/NN/d/iface.go::CloserNN", "implements", 0.75),
        ("go/NN/d/impl10.go::Impl10.ShutNN", "go/NN/d/iface.go::CloserNN", "overrides", 0.75),
        ("go/NN/d/impl11.go::Impl11", "go/NN/d/iface.go::CloserNN", "implements", 0.75),
        ("go/NN/d/impl11.go::Impl11.ShutNN", "go/NN/d/iface.go::CloserNN", "overrides", 0.75),
        ("go/NN/d/impl12.go::Impl12", "go/NN/d/iface.go::CloserNN", "implements", 0.75),
        ("go/NN/d/impl12.go::Impl12.ShutNN", "go/NN/d/iface.go::CloserNN", "overrides", 0.75),
        ("go/NN/d/impl13.go::Impl13", "go/NN/d/iface.go::CloserNN", "implements", 0.75),
        ("go/NN/d/impl13.go::Impl13.ShutNN", "go/NN/d/iface.go::CloserNN", "overrides", 0.75),
        ("go/NN/d/impl14.go::Impl14", "go/NN/d/iface.go::CloserNN", "implements", 0.75),
        ("go/NN/d/impl14.go::Impl14.ShutNN", "go/NN/d/iface.go::CloserNN", "overrides", 0.75),
        ("go/NN/d/impl15.go::Impl15", "go/NN/d/iface.go::CloserNN", "implements", 0.75),
        ("go/NN/d/impl15.go::Impl15.ShutNN", "go/NN/d/iface.go::CloserNN", "overrides", 0.75),
        ("go/NN/d/impl16.go::Impl16", "go/NN/d/iface.go::CloserNN", "implements", 0.75),
        ("go/NN/d/impl16.go::Impl16.ShutNN", "go/NN/d/iface.go::CloserNN", "overrides", 0.75),
        ("go/NN/d/impl17.go::Impl17", "go/NN/d/iface.go::CloserNN", "implements", 0.75),
        ("go/NN/d/impl17.go::Impl17.ShutNN", "go/NN/d/iface.go::CloserNN", "overrides", 0.75),
        ("go/NN/d/impl18.go::Impl18", "go/NN/d/iface.go::CloserNN", "implements", 0.75),
        ("go/NN/d/impl18.go::Impl18.ShutNN", "go/NN/d/iface.go::CloserNN", "overrides", 0.75),
        ("go/NN/d/impl19.go::Impl19", "go/NN/d/iface.go::CloserNN", "implements", 0.75),
        ("go/NN/d/impl19.go::Impl19.ShutNN", "go/NN/d/iface.go::CloserNN", "overrides", 0.75),
        ("go/NN/d/impl20.go::Impl20", "go/NN/d/iface.go::CloserNN", "implements", 0.75),
        ("go/NN/d/impl20.go::Impl20.ShutNN", "go/NN/d/iface.go::CloserNN", "overrides", 0.75),
        ("go/NN/d/impl21.go::Impl21", "go/NN/d/iface.go::CloserNN", "implements", 0.75),
        ("go/NN/d/impl21.go::Impl21.ShutNN", "go/NN/d/iface.go::CloserNN", "overrides", 0.75),
        ("go/NN/d/impl22.go::Impl22", "go/NN/d/iface.go::CloserNN", "implements", 0.75),
        ("go/NN/d/impl22.go::Impl22.ShutNN", "go/NN/d/iface.go::CloserNN", "overrides", 0.75),
        ("go/NN/d/impl23.go::Impl23", "go/NN/d/iface.go::CloserNN", "implements", 0.75),
        ("go/NN/d/impl23.go::Impl23.ShutNN", "go/NN/d/iface.go::CloserNN", "overrides", 0.75),
        ("go/NN/d/impl24.go::Impl24", "go/NN/d/iface.go::CloserNN", "implements", 0.75),
        ("go/NN/d/impl24.go::Impl24.ShutNN", "go/NN/d/iface.go::CloserNN", "overrides", 0.75),
        ("go/NN/d/impl25.go::Impl25", "go/NN/d/iface.go::CloserNN", "implements", 0.75),
        ("go/NN/d/impl25.go::Impl25.ShutNN", "go/NN/d/iface.go::CloserNN", "overrides", 0.75),
        ("go/NN/d/impl26.go::Impl26", "go/NN/d/iface.go::CloserNN", "implements", 0.75),
        ("go/NN/d/impl26.go::Impl26.ShutNN", "go/NN/d/iface.go::CloserNN", "overrides", 0.75),
        ("go/NN/d/impl27.go::Impl27", "go/NN/d/iface.go::CloserNN", "implements", 0.75),
        ("go/NN/d/impl27.go::Impl27.ShutNN", "go/NN/d/iface.go::CloserNN", "overrides", 0.75),
    ],
    "local_types_code": [
        ("cpp/NN/a.cpp::EngineNN.EngineNN", "pump", "PUMPNN"),
        ("cpp/NN/a.cpp::EngineNN.runNN", "pump", "PUMPNN"),
        ("cpp/NN/a.cpp::EngineNN.stepNN#2", "other", "PUMPNN"),
        ("cpp/NN/a.cpp::EngineNN.stepNN#2", "pump", "PUMPNN"),
        ("cpp/NN/a.cpp::EngineNN.stepNN", "pump", "PUMPNN"),
        ("cs/NN/App.cs::AppNN.AppNN", "s", "STORENN"),
        ("cs/NN/App.cs::AppNN.AppNN", "store", "STORENN"),
        ("cs/NN/App.cs::AppNN.HelpNN#2", "store", "STORENN"),
        ("cs/NN/App.cs::AppNN.HelpNN", "store", "STORENN"),
        ("cs/NN/App.cs::AppNN.RunNN", "q", "QUEUENN"),
        ("cs/NN/App.cs::AppNN.RunNN", "store", "STORENN"),
        ("go/NN/cache.go::Cache.Get", "c", "CACHE"),
        ("go/NN/cache.go::Cache.Write", "c", "CACHE"),
        ("go/NN/cache.go::Writer.Write", "w", "WRITER"),
        ("go/NN/main.go::Server.Serve", "cache", "CACHE"),
        ("go/NN/main.go::Server.Serve", "s", "SERVER"),
        ("go/NN/main.go::Server.Serve", "w", "WRITER"),
        ("go/NN/main.go::Server.log", "cache", "CACHE"),
        ("go/NN/main.go::Server.log", "s", "SERVER"),
        ("java/NN/app/ServiceNN.java::ServiceNN.check", "repo", "REPONN"),
        ("java/NN/app/ServiceNN.java::ServiceNN.check", "s", "STRING"),
        ("java/NN/app/ServiceNN.java::ServiceNN.helper", "repo", "REPONN"),
        ("java/NN/app/ServiceNN.java::ServiceNN.helper", "s", "STRING"),
        ("java/NN/app/ServiceNN.java::ServiceNN.make", "repo", "REPONN"),
        ("java/NN/app/ServiceNN.java::ServiceNN.pick#2", "repo", "REPONN"),
        ("java/NN/app/ServiceNN.java::ServiceNN.pick", "repo", "REPONN"),
        ("java/NN/app/ServiceNN.java::ServiceNN.pick", "s", "STRING"),
        ("java/NN/app/ServiceNN.java::ServiceNN.run", "id", "STRING"),
        ("java/NN/app/ServiceNN.java::ServiceNN.run", "repo", "REPONN"),
        ("java/NN/app/TaskNN.java::TaskNN.info", "s", "STRING"),
        ("java/NN/store/CacheNN.java::CacheNN.save", "id", "STRING"),
        ("java/NN/store/RepoNN.java::RepoNN.save", "id", "STRING"),
        ("php/NN/Shop.php::ShopNN.__construct", "cart", "CARTNN"),
        ("php/NN/Shop.php::ShopNN.anyNN", "cart", "CARTNN"),
        ("php/NN/Shop.php::ShopNN.buyNN", "cart", "CARTNN"),
        ("php/NN/Shop.php::ShopNN.makeNN", "cart", "CARTNN"),
        ("py/NN/app.py::AppNN.__init__", "store", "STORE"),
        ("py/NN/app.py::AppNN.run", "item", "ITEM"),
        ("py/NN/app.py::AppNN.run", "store", "STORE"),
        ("py/NN/app.py::AppNN.size", "store", "STORE"),
        ("py/NN/app.py::AppNN.step", "store", "STORE"),
        ("rs/NN/core/src/main.rs::Job.drive", "sink", "SINK"),
        ("rs/NN/core/src/main.rs::Job.finish", "sink", "SINK"),
        ("rs/NN/core/src/main.rs::Job.new", "sink", "SINK"),
        ("ts/NN/app.ts::AppNN.constructor", "store", "STORE"),
        ("ts/NN/app.ts::AppNN.start", "c", "CACHE"),
        ("ts/NN/app.ts::AppNN.start", "store", "STORE"),
        ("ts/NN/app.ts::AppNN.stop", "store", "STORE"),
    ],
    "native_imports": [
        ("file:cpp/NN/a.cpp", "file:cpp/NN/b.hpp", 0.95),
        ("file:py/NN/app.py", "file:py/NN/store.py", 0.94),
        ("file:py/NN/broken.py", "file:py/NN/app.py", 0.94),
        ("file:py/NN/test_app.py", "file:py/NN/app.py", 0.94),
        ("file:rs/NN/core/src/main.rs", "file:rs/NN/core/src/parse.rs", 0.93),
    ],
    "native_python_calls": [
        ("py/NN/app.py::AppNN.step", "py/NN/app.py::helper", 0.98),
        ("py/NN/app.py::helper", "py/NN/store.py::Store.__init__", 0.98),
        ("py/NN/test_app.py::aid", "py/NN/app.py::helper", 0.98),
        ("py/NN/test_app.py::test_helper", "py/NN/app.py::helper", 0.98),
        ("py/NN/test_app.py::test_via", "py/NN/test_app.py::aid", 0.98),
    ],
    "native_types": [
        ("cpp/NN/a.cpp::EngineNN.EngineNN", "cpp/NN/a.cpp::EngineNN", "uses-type", 0.93),
        ("cpp/NN/a.cpp::EngineNN.stepNN#2", "cpp/NN/a.cpp::EngineNN", "uses-type", 0.93),
        ("cpp/NN/a.cpp::EngineNN.stepNN#2", "cpp/NN/b.hpp::PumpNN", "uses-type", 0.93),
        ("cs/NN/App.cs::AppNN.AppNN", "cs/NN/App.cs::AppNN", "uses-type", 0.95),
        ("cs/NN/App.cs::AppNN.AppNN", "cs/NN/Store.cs::StoreNN", "uses-type", 0.95),
        ("cs/NN/App.cs::AppNN.RunNN", "cs/NN/Conv.cs::ConvNN", "uses-type", 0.93),
        ("cs/NN/App.cs::AppNN.RunNN", "cs/NN/Store.cs::QueueNN", "uses-type", 0.93),
        ("java/NN/app/ServiceNN.java::ServiceNN", "java/NN/app/BaseNN.java::BaseNN", "extends", 0.97),
        ("java/NN/app/ServiceNN.java::ServiceNN.make", "java/NN/store/RepoNN.java::RepoNN", "uses-type", 0.96),
        ("java/NN/app/ServiceNN.java::ServiceNN.run", "java/NN/app/TaskNN.java::TaskNN", "uses-type", 0.94),
        ("java/NN/app/TaskNN.java::TaskNN.TaskNN", "java/NN/app/TaskNN.java::TaskNN", "uses-type", 0.96),
        ("php/NN/Shop.php::ShopNN.__construct", "php/NN/Cart.php::CartNN", "uses-type", 0.94),
        ("php/NN/Shop.php::ShopNN.buyNN", "php/NN/Wish.php::WishNN", "uses-type", 0.9),
        ("php/NN/Shop.php::ShopNN.makeNN", "php/NN/Cart.php::CartNN", "uses-type", 0.9),
        ("py/NN/app.py::helper", "py/NN/store.py::Store", "uses-type", 0.96),
        ("rs/NN/core/src/main.rs::Job.drive", "rs/NN/core/src/main.rs::Job", "uses-type", 0.94),
        ("rs/NN/core/src/main.rs::Job.new", "rs/NN/core/src/main.rs::Job", "uses-type", 0.94),
        ("rs/NN/core/src/main.rs::Job.new", "rs/NN/core/src/main.rs::Sink", "uses-type", 0.94),
    ],
    "scope_semi_join": [
        ("crate:rs/NN/core", "crate:rs/NN/facade_NN"),
        ("crate:rs/NN/core", "crate:rs/NN/printer_NN"),
        ("crate:rs/NN/printer_NN", "crate:rs/NN/facade_NN"),
        ("crate:rs/NN/printer_NN", "crate:rs/NN/private_NN"),
        ("go/NN/cache.go", "go/NN/main.go"),
        ("go/NN/main.go", "go/NN/cache.go"),
        ("go/NN/main.go", "go/NN/renderNN/render.go"),
        ("java/NN/app/BaseNN.java", "java/NN/app/ServiceNN.java"),
        ("java/NN/app/BaseNN.java", "java/NN/app/TaskNN.java"),
        ("java/NN/app/ServiceNN.java", "java/NN/app/BaseNN.java"),
        ("java/NN/app/ServiceNN.java", "java/NN/app/TaskNN.java"),
        ("java/NN/app/ServiceNN.java", "java/NN/store/RepoNN.java"),
        ("java/NN/app/TaskNN.java", "java/NN/app/BaseNN.java"),
        ("java/NN/app/TaskNN.java", "java/NN/app/ServiceNN.java"),
        ("java/NN/store/CacheNN.java", "java/NN/store/RepoNN.java"),
        ("java/NN/store/RepoNN.java", "java/NN/store/CacheNN.java"),
        ("py/NN/app.py", "py/NN/store.py"),
        ("py/NN/broken.py", "py/NN/app.py"),
        ("py/NN/test_app.py", "py/NN/app.py"),
        ("ts/NN/app.ts", "ts/NN/store.ts"),
        ("ts/NN/store.ts", "ts/NN/cache.ts"),
    ],
    "tests_edge_confidence_tiers": [
        ("py/NN/test_app.py::aid", "py/NN/app.py::helper", 0.85, "test-evidence"),
        ("py/NN/test_app.py::aid", "py/NN/store.py::Store.__init__", 0.55, "test-evidence"),
        ("py/NN/test_app.py::test_helper", "py/NN/app.py::helper", 0.8, "test-evidence"),
        ("py/NN/test_app.py::test_helper", "py/NN/store.py::Store.__init__", 0.55, "test-evidence"),
        ("py/NN/test_app.py::test_via", "py/NN/app.py::helper", 0.75, "test-evidence"),
        ("py/NN/test_app.py::test_via", "py/NN/store.py::Store.__init__", 0.55, "test-evidence"),
    ],
    "uses_type_tokens": [
        ("cpp/NN/a.cpp::EngineNN.stepNN#2", "cpp/NN/a.cpp::EngineNN", 0.5),
        ("cpp/NN/a.cpp::EngineNN.stepNN#2", "cpp/NN/a.cpp::EngineNN.EngineNN", 0.5),
        ("cs/NN/App.cs::AppNN.AppNN", "cs/NN/Store.cs::StoreNN", 0.5),
        ("go/NN/cache.go::Cache.Get", "go/NN/cache.go::Cache", 0.5),
        ("go/NN/cache.go::Cache.Write", "go/NN/cache.go::Cache", 0.5),
        ("go/NN/cache.go::Writer.Write", "go/NN/cache.go::Writer", 0.5),
        ("go/NN/d/iface.go::Drive", "go/NN/d/iface.go::CloserNN", 0.5),
        ("go/NN/d/impl10.go::Impl10.ShutNN", "go/NN/d/impl10.go::Impl10", 0.5),
        ("go/NN/d/impl11.go::Impl11.ShutNN", "go/NN/d/impl11.go::Impl11", 0.5),
        ("go/NN/d/impl12.go::Impl12.ShutNN", "go/NN/d/impl12.go::Impl12", 0.5),
        ("go/NN/d/impl13.go::Impl13.ShutNN", "go/NN/d/impl13.go::Impl13", 0.5),
        ("go/NN/d/impl14.go::Impl14.ShutNN", "go/NN/d/impl14.go::Impl14", 0.5),
        ("go/NN/d/impl15.go::Impl15.ShutNN", "go/NN/d/impl15.go::Impl15", 0.5),
        ("go/NN/d/impl16.go::Impl16.ShutNN", "go/NN/d/impl16.go::Impl16", 0.5),
        ("go/NN/d/impl17.go::Impl17.ShutNN", "go/NN/d/impl17.go::Impl17", 0.5),
        ("go/NN/d/impl18.go::Impl18.ShutNN", "go/NN/d/impl18.go::Impl18", 0.5),
        ("go/NN/d/impl19.go::Impl19.ShutNN", "go/NN/d/impl19.go::Impl19", 0.5),
        ("go/NN/d/impl20.go::Impl20.ShutNN", "go/NN/d/impl20.go::Impl20", 0.5),
        ("go/NN/d/impl21.go::Impl21.ShutNN", "go/NN/d/impl21.go::Impl21", 0.5),
        ("go/NN/d/impl22.go::Impl22.ShutNN", "go/NN/d/impl22.go::Impl22", 0.5),
        ("go/NN/d/impl23.go::Impl23.ShutNN", "go/NN/d/impl23.go::Impl23", 0.5),
        ("go/NN/d/impl24.go::Impl24.ShutNN", "go/NN/d/impl24.go::Impl24", 0.5),
        ("go/NN/d/impl25.go::Impl25.ShutNN", "go/NN/d/impl25.go::Impl25", 0.5),
        ("go/NN/d/impl26.go::Impl26.ShutNN", "go/NN/d/impl26.go::Impl26", 0.5),
        ("go/NN/d/impl27.go::Impl27.ShutNN", "go/NN/d/impl27.go::Impl27", 0.5),
        ("go/NN/main.go::NewWriter", "go/NN/cache.go::Writer", 0.5),
        ("go/NN/main.go::Server.Serve", "go/NN/main.go::Server", 0.5),
        ("go/NN/main.go::Server.log", "go/NN/main.go::Server", 0.5),
        ("java/NN/app/ServiceNN.java::ServiceNN", "java/NN/app/BaseNN.java::BaseNN", 0.5),
        ("java/NN/app/ServiceNN.java::ServiceNN.make", "java/NN/store/RepoNN.java::RepoNN", 0.5),
        ("java/NN/app/ServiceNN.java::ServiceNN.repo", "java/NN/store/RepoNN.java::RepoNN", 0.5),
        ("php/NN/Shop.php::ShopNN.__construct", "php/NN/Cart.php::CartNN", 0.5),
        ("py/NN/app.py::AppNN", "py/NN/store.py::BaseNN", 0.5),
        ("ts/NN/app.ts::AppNN", "ts/NN/store.ts::BaseNN", 0.5),
        ("ts/NN/app.ts::AppNN.constructor", "ts/NN/store.ts::Store", 0.5),
    ],
}
